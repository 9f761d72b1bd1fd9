"""The full-text index: chunks, postings, lengths, slugs; building, refreshing, sweeping."""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gate, paths, text
from ..sources import vault
from . import lines

#: Columns of the index and their weights.
WEIGHTS = {"tag": 5.0, "heading": 4.0, "keywords": 3.0, "content": 1.0}


def build_chunks(files: DataFrame) -> DataFrame:
    """chunk_id, path, workspace, ci, heading, content, mtime, hash, tag, keywords of all chunks of ``files``.

    chunk_id is a function of path and position, so that refreshed files keep the ids of what has not moved.
    """
    first = F.array_join(F.array_distinct(F.concat(text.inline_tags("content"), F.when(F.col("ci") == 0, F.col("fm_tags")).otherwise(F.array().cast("array<string>")))), " ")
    rows = files.select("path", "workspace", "mtime", vault.front_tags("text").alias("fm_tags"), vault.body("text").alias("text"))
    cut = lines.chunks(rows)
    tag = lambda c: gate.known_tag(c)
    return cut.select(
        F.xxhash64("path", "ci").alias("chunk_id"), "path", "workspace", "ci", "heading", "content", "mtime", text.chunk_hash("content").alias("hash"),
        F.coalesce(F.nullif(tag("heading"), F.lit("")), tag("content")).alias("tag"), first.alias("keywords"),
    )


def build_postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, col, n_tokens (of the whole chunk), tf, positions: one row for each term of a chunk's column."""
    cols = list(WEIGHTS)
    tokens = F.array(*(F.struct(F.lit(c).alias("col"), text.search_tokens(F.coalesce(F.col(c), F.lit(""))).alias("tokens")) for c in cols))
    cut = text.computed_once(chunks.select("chunk_id", *cols), "t", tokens)
    size = F.aggregate("t", F.lit(0), lambda n, c: n + F.size(c["tokens"]))
    rows = cut.select("chunk_id", size.alias("n_tokens"), F.explode("t").alias("t")).select("chunk_id", "n_tokens", "t.col", "t.tokens").filter(F.size("tokens") > 0)
    kind = rows.schema["chunk_id"].dataType

    def grouped(batches):
        """A chunk's tokens are together already, so that no shuffle is needed to group them."""
        for batch in batches:
            lists = batch.column("tokens")
            n = np.diff(lists.offsets.to_numpy())
            terms = lists.flatten().dictionary_encode()
            row, code = np.repeat(np.arange(len(n)), n), terms.indices.to_numpy()
            pos = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((code, row))  # stable: positions stay in order
            row, code = row[order], code[order]
            starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(code) else np.empty(0, int)
            ends = np.append(starts, len(code))
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[order], pa.int32()))
            of = pa.array(row[starts])
            columns = [terms.dictionary.take(pa.array(code[starts])), *(batch.column(c).take(of) for c in ("chunk_id", "col", "n_tokens")), pa.array(np.diff(ends), pa.int64()), positions]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "chunk_id", "col", "n_tokens", "tf", "positions"])

    return rows.mapInArrow(grouped, f"term string, chunk_id {kind.simpleString()}, col string, n_tokens int, tf long, positions array<int>")


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", sum((F.size(text.search_tokens(F.coalesce(F.col(c), F.lit("")))) for c in WEIGHTS), F.lit(0)).alias("n_tokens"))


def bucket(term: str | Column, buckets: int | Column) -> int | Column:
    """The bucket of the postings a term lies in: the same number here and in a plan."""
    if isinstance(term, str):
        return zlib.crc32(term.encode()) % buckets
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def write_index(chunks: DataFrame, path: str, buckets: int = 64, deals: int | None = None) -> None:
    """Chunks by workspace, lengths, statistics, and postings by the bucket of the term, sorted by it.

    A query reads the buckets of its terms only, and in them the row groups that hold a term.  Nothing is shuffled: each task of
    ``chunks`` sorts its own postings and writes a file in every bucket, so that a frequent term is spread over the tasks;
    ``deals``, the tasks of a bucket when postings were shuffled, decides nothing any more.
    """
    chunks.write.mode("overwrite").partitionBy("workspace").parquet(f"{path}/chunks")
    placed = build_postings(chunks).withColumn("part", bucket(F.col("term"), F.lit(buckets)))
    placed.sortWithinPartitions("part", "term", "chunk_id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    chunk_lengths(chunks).write.mode("overwrite").parquet(f"{path}/lengths")
    lengths = chunks.sparkSession.read.parquet(f"{path}/lengths")
    lengths.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")


_POSTINGS = "term string, chunk_id long, col string, n_tokens int, tf long, positions array<int>, part int"


@dataclass(frozen=True)
class StoredIndex:
    """An index that ``write_index`` has written, with the statistics of its chunks."""

    path: str
    postings: DataFrame
    chunks: int
    tokens: int
    buckets: int

    @property
    def mean_length(self) -> float:
        return self.tokens / max(1, self.chunks)

    def postings_of(self, terms: Iterable[str]) -> DataFrame:
        """The postings of some terms; the plan reads their buckets only."""
        terms = sorted(set(terms))
        parts = sorted({bucket(t, self.buckets) for t in terms})
        return self.postings.filter(F.col("part").isin(*parts) & F.col("term").isin(*terms)).drop("part")


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    """Reads the one row of statistics; postings are read by the queries."""
    row = spark.read.parquet(f"{path}/statistics").first()
    return StoredIndex(path, spark.read.schema(_POSTINGS).parquet(f"{path}/postings"), row["chunks"], row["tokens"], row["buckets"])


def refresh(old: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks after files have changed: those of ``changed`` paths anew (none where the file is gone), all others as they were."""
    new = build_chunks(files.join(changed.select("path").distinct(), "path", "left_semi"))
    return old.join(changed.select("path").distinct(), "path", "left_anti").unionByName(new.select(*old.columns))


def changed_paths(old: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that are new, gone, or of another time than their chunks (by more than a microsecond)."""
    seen = old.groupBy("path").agg(F.max("mtime").alias("was"))
    both = files.select("path", "mtime").join(seen, "path", "full_outer")
    return both.filter(F.col("was").isNull() | F.col("mtime").isNull() | (F.abs(F.col("mtime") - F.col("was")) > 1e-6)).select("path")


def slugs(files: DataFrame) -> DataFrame:
    """workspace, slug, path, title, status, parents, aliases, last_touched: first path of each slug by scan order wins."""
    f = vault.front("text")
    listed = lambda k: F.filter(text.split_quoted_csv(F.regexp_replace(F.coalesce(f[k], F.lit("")), r"^\[|\]$", "")), lambda x: x != "")
    rows = files.filter(paths.is_topic_file("path") & ~paths.name("path").rlike(paths.DATED_ASPECT) & (paths.name("path") != paths.LESSONS)).select(
        "workspace", F.coalesce(f["slug"], paths.slug("path")).alias("slug"), "path", F.coalesce(f["title"], paths.slug("path")).alias("title"), f["status"].alias("status"), listed("parents").alias("parents"), listed("aliases").alias("aliases"), f["last_touched"].alias("last_touched"),
    )
    return first_wins(rows, ["workspace", "slug"], "path")


def topics_by_recency(slugs_: DataFrame, n: int | None = None) -> DataFrame:
    """Topics, last touched first, those without a date last; the first ``n`` of them if given."""
    rows = slugs_.orderBy(F.desc_nulls_last("last_touched"), "workspace", "slug")
    return rows if n is None else rows.limit(n)


def first_wins(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def orphans(chunks: DataFrame, files: DataFrame, archived: DataFrame, deleted: DataFrame) -> DataFrame:
    """path, rows, recoverable of indexed paths whose file is gone: recoverable from the archive (by stem) or from history."""
    gone = chunks.filter(~paths.is_archive("path")).groupBy("path").agg(F.count("*").alias("rows")).join(files.select("path"), "path", "left_anti")
    stems = archived.select(paths.archive_stem("path").alias("stem")).distinct().withColumn("in_archive", F.lit(True))
    known = deleted.select("path").distinct().withColumn("in_history", F.lit(True))
    stem = F.regexp_replace(paths.name("path"), r"\.md$", "")
    return gone.withColumn("stem", stem).join(stems, "stem", "left").join(known, "path", "left").select("path", "rows", F.coalesce("in_archive", "in_history", F.lit(False)).alias("recoverable"))


def orphan_summary(orphans_: DataFrame) -> DataFrame:
    return orphans_.agg(F.count("*").alias("paths"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if("recoverable").alias("recoverable"), F.count_if(~F.col("recoverable")).alias("unrecoverable"))


def sweep(chunks: DataFrame, orphans_: DataFrame, force: bool = False) -> DataFrame:
    """Chunks without those of recoverable orphans; of all orphans with ``force``."""
    gone = orphans_ if force else orphans_.filter("recoverable")
    return chunks.join(gone.select("path"), "path", "left_anti")
