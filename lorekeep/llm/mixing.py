"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target of words.  Whole passes over the source come first; what remains of the target is
fitted on the source's histogram of exact lengths: each length gives its proportional share, a descending pass
brings the rest under ``dp_budget`` words and a bounded-knapsack dynamic program closes it.  The plan says how
many documents of each length to take, and a seeded hash order says which.  Only the histogram (one row per
source and length) reaches the program; documents are never gathered.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, discard, free_name, materialize, table, text_or_empty

WEIGHTS = (5, 2, 1)
#: Documents of one source and length are ordered in hash ranges of about this many.
RANGE_ROWS = 1024
#: Rows of the plan (sources x lengths) up to which it is broadcast; beyond, it is joined by key.
BROADCAST_ROWS = 200_000


def source_weights(hist: DataFrame, weights=WEIGHTS) -> DataFrame:
    """s, size, w: the sources of a histogram (s, l, n) with their words and weights, by code point and null last.

    Ranks come from ranges of sources and the ranges' counts, so that no task sorts all of them.
    """
    sizes = hist.groupBy("s").agg(F.sum(F.col("l") * F.col("n")).cast("decimal(38,0)").alias("size"))
    ranged = sizes.withColumn("last", F.col("s").isNull()).repartitionByRange("last", "s").sortWithinPartitions("last", "s")
    at = F.monotonically_increasing_id()
    ranged = materialize(ranged.select("s", "size", F.shiftright(at, 33).alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "mix-sources")
    counts = ranged.groupBy("range").agg(F.count("*").alias("c"))  # a row for each range
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("i") + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    out = materialize(ranged.join(F.broadcast(before), "range").select("s", "size", weight.cast("int").alias("w")), "mix-weights")
    discard(ranged)
    return out


def with_targets(sources: DataFrame, share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """``sources`` (s, size, w) with target, min(max_epochs x size, level x w) at the level at which targets sum up.

    Only sums reach the driver; the level rises, as more sources are at their limit, until no further one is.
    """
    cap = (F.col("size") * max_epochs).cast("decimal(38,0)")
    total = Fraction(share) * int(sources.agg(F.sum("size")).first()[0] or 0)
    kinds = [r.w for r in sources.select("w").distinct().collect()]  # at most as many as there are weights
    level = Fraction(0)

    def by_weight(value, kind: str):
        return F.element_at(F.create_map(*(x for w in kinds for x in (F.lit(w), F.lit(str(value(w))).cast(kind)))), F.col("w"))

    while kinds:
        # a source is at its limit if level x w exceeds it; the limit is a whole number
        over = cap < by_weight(lambda w: math.ceil(level * w), "decimal(38,0)")
        row = sources.agg(F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        new = (total - int(row.capped or 0)) / int(row.w) if row.w else level
        if new == level:
            return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(by_weight(lambda w: repr(float(level * w)), "double")))
        level = new
    return sources.withColumn("target", F.lit(0.0))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = 1 << 15) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget`` from below or exactly.

    The program's table has an entry for each word that is left: at most ``dp_budget`` and the longest document's.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total if total else 0 for c in counts], np.int64)
    take[lengths == 0] = 0
    rest = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= dp_budget:
            break
        if lengths[i] > 0:
            add = min(int(counts[i] - take[i]), max(0, (rest - dp_budget) // int(lengths[i])))
            take[i] += add
            rest -= add * int(lengths[i])
    # every sum up to rest, with the first item that reached it; binary splitting keeps the items few
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    by = np.full(rest + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        size = int(lengths[i])
        free = int(counts[i] - take[i])
        if size == 0 or free == 0 or size > rest:
            continue
        free, pack = min(free, rest // size), 1
        while free > 0:
            n = min(pack, free)
            width = n * size
            new = np.zeros_like(reached)
            new[width:] = reached[: rest + 1 - width]
            new &= ~reached
            by[new] = len(items)
            items.append((int(i), n))
            reached |= new
            free -= n
            pack *= 2
        if reached[rest]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def word_total(text: str = "text"):
    return F.regexp_count(text_or_empty(text), F.lit(WORD_PATTERN)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: int = 3, seed: int = 17, text: str | None = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes of the row, repeats counted).

    With ``text=None`` the column size is given: large texts are then read once, by whoever measured them.

    Null texts count as empty and null sources as a source of their own, last in order.  Repeated rows are separate
    documents; ties of the seeded order fall by key and then by the hash of the text.  Documents without words take
    nothing.  An empty table gives an empty result.  Existing columns of the four names are replaced.
    """
    docs = docs.drop("source_size", "target", "taken", *(["size"] if text else []))
    h, tie = free_name(docs, "mix_h"), free_name(docs, "mix_tie")
    docs = docs.withColumns({
        "size": word_total(text) if text else F.col("size"),
        h: F.xxhash64(F.lit(seed), F.col(key)),
        tie: F.xxhash64(text_or_empty(text)) if text else F.lit(0),
    })
    hist = materialize(docs.groupBy(F.col(source).alias("s"), F.col("size").alias("l")).agg(F.count("*").alias("n")), "mix-hist")
    sources = source_weights(hist, weights)
    targets = with_targets(sources, share, max_epochs).select(F.col("s").alias("t"), F.col("size").cast("long").alias("source_size"), "target")

    def plan_of(group: pd.DataFrame) -> pd.DataFrame:
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        goal = round(target)
        epochs = goal // size if size else 0
        extra = fit_counts(group["l"].to_numpy(), group["n"].to_numpy(), goal - epochs * size)
        return pd.DataFrame({"s": group["s"], "l": group["l"], "n": group["n"], "x": extra, "epochs": epochs, "source_size": size, "target": target})

    planned = hist.join(targets, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    plan = materialize(planned.groupBy("s").applyInPandas(plan_of, "s string, l long, n long, x long, epochs long, source_size long, target double"), "mix-plan")
    discard(hist, sources)
    small = plan.count() <= BROADCAST_ROWS
    p = {c: free_name(docs, f"mix_{c}") for c in ("s", "l", "n", "x", "epochs")}
    plan = plan.withColumnsRenamed(p)
    joined = docs.join(F.broadcast(plan) if small else plan, docs[source].eqNullSafe(plan[p["s"]]) & (docs["size"] == plan[p["l"]])).drop(p["s"], p["l"])
    part, rank, before, rows = (free_name(docs, f"mix_{c}") for c in ("range", "rank", "before", "rows"))
    # the hash as a fraction of its range, times the number of ranges
    joined = joined.withColumn(part, F.floor((F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))) * F.ceil(F.col(p["n"]) / RANGE_ROWS)).cast("long"))
    w = Window.partitionBy(source, "size", part)
    ranked = joined.withColumn(rank, F.row_number().over(w.orderBy(h, key, tie)))
    ranges = (
        joined.filter(F.col(p["n"]) > RANGE_ROWS).groupBy(source, "size", part).agg(F.count("*").alias(rows))
        .withColumn(before, F.sum(rows).over(Window.partitionBy(source, "size").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)))
    )
    a, b = ranked.alias("a"), ranges.alias("b")
    out = a.join(b, F.col(f"a.{source}").eqNullSafe(F.col(f"b.{source}")) & (F.col("a.size") == F.col("b.size")) & (F.col(f"a.{part}") == F.col(f"b.{part}")), "left").select("a.*", f"b.{before}")
    first = F.col(rank) + F.coalesce(F.col(before), F.lit(0)) <= F.col(p["x"])
    out = out.withColumn("taken", F.col("size") * (F.col(p["epochs"]) + F.when(first, 1).otherwise(0)))
    return out.drop(h, tie, part, rank, before, *p.values())


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs`` and whatever these are called.

    Rows without words are never taken; null sources are a source; repeated rows are taken each; see ``mix``.
    """
    columns = docs.columns
    mixed = mix(docs, **options)
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    copy = free_name(mixed, "copy")
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(*columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", word_total().alias("size")), "mix-sizes")
    return mix(sized, text=None).select("doc_id", "source", "size", "source_size", "target", "taken")
