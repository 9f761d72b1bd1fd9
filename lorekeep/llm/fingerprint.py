"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in expressions only.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's word shingles, sorted.  Sketches of parts merge
into the sketch of the whole; from two sketches come estimates of resemblance and containment, from one the number
of distinct shingles.  Hashes are Spark's xxhash64 of the shingle's words joined by one space, ordered as signed
longs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, table, text_or_empty

K, WIDTH = 128, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LONGS = 2.0**64


def words(text: Column) -> Column:
    """ASCII-lower-cased runs between ASCII white space."""
    # one blank for each kind of white space, so that a split by a plain blank will do
    plain = F.translate(text, _UPPER + "\t\n\x0b\x0c\r", _LOWER + "     ")
    return F.array_remove(F.split(plain, " "), "")


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the word shingles; a text of fewer words is one shingle, one without words has none."""
    return F.transform(
        F.array(words(text)),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) <= width, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, width), " ")))),
    )[0]


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for each group of ``keys``: hashes meet by value first, so that a large group is never one array."""
    h, n = free_name(df, "h"), free_name(df, "n")
    rows = df.select(*keys, F.explode(sketch).alias(h)).distinct()
    # a hash among the k least of its group is among the k least of its part
    part = F.pmod(F.xxhash64(h), F.lit(64))
    near = rows.withColumn("__part", part).withColumn(n, F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(h))).filter(F.col(n) <= k)
    least = near.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(h))).filter(F.col(n) <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list(h)).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of common hashes among the k least of both; 1 for two empty sketches."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / F.greatest(F.size(both), F.lit(1))).cast("double")


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact while there are fewer than k."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / _LONGS
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too: 1 for an empty a."""
    union = distinct_count(merge(a, b, k), k)
    both = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """Sixteen hex digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def range_heads(ids: DataFrame, parts: int) -> DataFrame:
    """One row with ``heads``: the first rows (id, th), in descending order, of about ``parts`` ranges of equal size."""
    dealt = ids.repartitionByRange(parts, F.desc("id"), F.desc("th"))
    heads = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct("id", "th")).alias("head"))
    return heads.agg(F.sort_array(F.collect_list("head"), asc=False).alias("heads"))  # as many as ranges


def range_of(row: Column, heads: Column, step: int) -> Column:
    """The number (from 0) of the range a row belongs to: every ``step``-th head is looked at, then the ones between."""
    coarse = F.size(F.filter(F.filter(heads, lambda h, i: i % step == 0), lambda h: h >= row)) - 1
    return F.get(F.transform(F.array(coarse), lambda c: c * step + F.size(F.filter(F.slice(heads, c * step + 1, step), lambda h: h >= row)) - 1), F.lit(0))


def edited_pairs(docs: DataFrame, k: int = K, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last half of the code points (rounded down) replaced by as many first ones of the next
    document in descending order of key, or by all it has; after the last comes the first.  Null texts count as empty
    and null keys come last.  Rows that repeat key and text count once in the order and each get its result; of equal
    keys with other texts the larger hash comes first.  A single document is its own next.  An empty table gives an
    empty result; other columns are ignored.

    Texts are shuffled once, by ranges of the order; the first row of each range goes to the range before it as well,
    so that every row finds the next one beside it.
    """
    spark, least = docs.sparkSession, F.lit(-(2**63)).cast("long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    step = max(1, math.isqrt(ranges))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(key).cast("long"), least).alias("id"), text_or_empty(text).alias("t")).withColumn("th", F.xxhash64("t"))
    heads = materialize(range_heads(rows.select("id", "th"), ranges), "range-heads")
    row = F.struct("id", "th")
    dealt = rows.crossJoin(F.broadcast(heads)).withColumn("r", range_of(row, F.col("heads"), step))  # one row of heads
    is_head = row == F.get("heads", F.col("r"))
    before = F.when(F.col("r") > 0, F.col("r") - 1).otherwise(F.size("heads") - 1)
    own = F.struct(F.col("r").alias("b"), F.lit(0).alias("guest"))
    places = F.when(is_head, F.array(own, F.struct(before.alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    placed = dealt.select("key", "id", "th", "t", F.explode(places).alias("p")).select("key", "id", "th", "t", "p.b", "p.guest").repartition(parts, "b")
    w = Window.partitionBy("b").orderBy("guest", F.desc("id"), F.desc("th"))
    made = placed.withColumn("s", sketch(F.col("t"), k, width))
    numbered = made.withColumns({"n": F.row_number().over(w), "last": F.lag(F.struct("guest", "id", "th")).over(w)})
    once = numbered.filter(F.col("last").isNull() | (F.col("last") != F.struct("guest", "id", "th")))
    beside = once.withColumns({"next": F.lead(F.struct("t", "s")).over(w), "copies": F.lead("n").over(w) - F.col("n")}).filter("guest = 0")
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    both = beside.select("key", "copies", "t", "s", F.col("next.s").alias("next_s"), n.cast("long").alias("n_chars"), F.concat(F.substring("t", F.lit(1), n - half), F.substring("next.t", F.lit(1), half)).alias("edited"))
    both = both.withColumn("e", sketch(F.col("edited"), k, width))
    out = both.select(
        F.col("key").alias(key), "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("s")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"), resemblance(F.col("s"), F.col("next_s"), k).alias("near_next"), distinct_count(F.col("s"), k).alias("n_shingles"), containment(F.col("s"), F.col("e"), k).alias("kept"), "copies",
    )
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH, text: str = "text") -> DataFrame:
    """``docs`` with sketch, fingerprint and n_shingles (estimated).

    Null texts count as empty, and an empty text has an empty fingerprint; equal texts have equal fingerprints.
    Existing columns of the three names are replaced.
    """
    docs = docs.drop("sketch", "fingerprint", "n_shingles").withColumn("sketch", sketch(text_or_empty(text), k, width))
    return docs.withColumns({"fingerprint": as_text(F.col("sketch")), "n_shingles": distinct_count(F.col("sketch"), k)})


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
