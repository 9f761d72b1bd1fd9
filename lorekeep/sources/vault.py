"""Reading and writing vaults, transcripts and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text

_HEADER = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def files(spark: SparkSession, root: str, pattern: str = "*.md", below: str = "") -> DataFrame:
    """path, workspace, kind, is_archive, mtime, size, text of the files below ``root``; gzip is read as what it holds.

    Listings leave out folders whose names start with a dot, so those are named by ``below``.
    """
    root = root.rstrip("/")
    raw = _whole_texts(spark, root, pattern, below)
    return _described(raw, root)


def _whole_texts(spark: SparkSession, root: str, pattern: str, below: str, corrupt: str = "false") -> DataFrame:
    return spark.read.option("ignoreCorruptFiles", corrupt).text(f"{root}/{below}", wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)


def _relative(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, r"^file:/*", "/")
    return F.substring(plain, F.lit(len(root) + 2), F.length(plain))


def _described(raw: DataFrame, root: str) -> DataFrame:
    rows = raw.select(_relative(F.col("_metadata.file_path"), root).alias("path"), (F.unix_micros("_metadata.file_modification_time") / 1e6).alias("mtime"), F.col("_metadata.file_size").alias("size"), F.coalesce("value", F.lit("")).alias("text"))
    return rows.select("path", paths.workspace("path").alias("workspace"), paths.kind("path").alias("kind"), paths.is_archive("path").alias("is_archive"), "mtime", "size", "text")


def archives(spark: SparkSession, root: str) -> DataFrame:
    """The archived files of a vault.  One that cannot be read has an empty text, so that no file fails a scan."""
    root = root.rstrip("/")
    read = _described(_whole_texts(spark, root, "*.gz", ".archive", "true"), root).select("path", "text")
    there = file_listing(spark, f"{root}/.archive", "*.gz").withColumn("path", _relative(F.col("path"), root))
    rows = there.join(read, "path", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("path", paths.workspace("path").alias("workspace"), paths.kind("path").alias("kind"), paths.is_archive("path").alias("is_archive"), "mtime", "size", "text")


def sources(files_: DataFrame) -> DataFrame:
    """Files to index: shared and workspace markdown, archives included, reserved names left out; with their order of scanning."""
    top = F.split(paths.inner("path"), "/")[0]
    order = F.when(F.col("workspace") == "shared", 0).when(top == "docs", 2).when(top == "journal", 3).when(top == "skills", 4).when(top == "research", 5).otherwise(1)
    return files_.filter((F.col("workspace") != "") & ~F.col("workspace").startswith("_")).withColumn("scan_order", order)


def topic_landings(files_: DataFrame) -> DataFrame:
    """One landing a topic folder: its README, else the note of the folder's own name."""
    rank = F.when(paths.name("path") == paths.README, 0).when(paths.name("path") == F.concat(paths.folder("path"), F.lit(".md")), 1)
    rows = files_.filter(paths.is_topic_file("path")).withColumns({"rank": rank, "topic": paths.folder("path")}).filter("rank is not null")
    w = Window.partitionBy("workspace", F.regexp_replace("path", "/[^/]+$", "")).orderBy("rank", "path")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "rank")


def workspaces(files_: DataFrame) -> DataFrame:
    """Workspaces that have a workspace.json, archived ones (``_``) left out."""
    return files_.filter((paths.name("path") == "workspace.json") & ~F.col("workspace").startswith("_")).select("workspace").distinct()


def header(text_: str | Column) -> Column:
    """The lines of the frontmatter, empty without one."""
    return F.regexp_extract(text.col(text_), _HEADER, 1)


def body(text_: str | Column) -> Column:
    return F.regexp_replace(text.col(text_), _HEADER, "")


def front(text_: str | Column) -> Column:
    """The frontmatter as a map of ``key: value``; of repeated keys the last counts, comment lines do not."""
    pairs = F.filter(F.split(header(text_), r"\r?\n"), lambda l: l.rlike(r"^[a-zA-Z_][\w-]*:") & ~l.startswith("#"))
    entries = F.transform(pairs, lambda l: F.struct(F.regexp_extract(l, r"^([a-zA-Z_][\w-]*):", 1), F.regexp_replace(F.regexp_extract(l, r"^[^:]+:\s*(.*?)\s*$", 1), r"""^(["'])(.*)\1$""", "$2")))
    return F.map_from_entries(last_by_key(entries, "col1"))


def last_by_key(entries: Column, key: str) -> Column:
    """Of an array of structs the last one of each key."""
    return text.let(entries, lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: o[key] == e[key])))


def front_tags(text_: str | Column) -> Column:
    """Tags of the frontmatter: flow list, scalar, or block list."""
    h = header(text_)
    flow = F.regexp_extract(h, r"(?m)^tags:\s*\[([^\]]*)\]", 1)
    block = F.regexp_extract(h, r"(?m)^tags:[ \t]*\r?\n((?:[ \t]*-[ \t]+.+(?:\r?\n|\z))+)", 1)
    scalar = F.regexp_extract(h, r"(?m)^tags:[ \t]*([^\s\[].*?)[ \t]*$", 1)
    items = F.when(flow != "", text.split_quoted_csv(flow)).when(block != "", F.transform(F.split(F.trim(block), r"\r?\n"), lambda l: F.regexp_replace(l, r"^[ \t]*-[ \t]+", ""))).when(scalar != "", F.split(scalar, r"\s*,\s*")).otherwise(F.array().cast("array<string>"))
    clean = F.transform(items, lambda t: F.lower(F.regexp_replace(F.trim(t), r"""^["'#]+|["']+$""", "")))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def render_front(fields: str | Column) -> Column:
    """The header text of a map, keys in order."""
    m = text.col(fields)
    return F.concat(F.lit("---\n"), F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), F.lit("\n---\n"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """file, line, record (variant) of transcript lines; lines that are no JSON objects are left out.

    Only files are read in whole lines, so the tail of a growing file is what a streaming file source delivers.
    """
    rows = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.try_parse_json(F.trim("value")).alias("record"))
    return rows.filter("record is not null").filter(F.schema_of_variant("record").startswith("OBJECT"))


def file_listing(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, size, mtime without reading any content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def activity(spark: SparkSession, path: str) -> DataFrame:
    """path, count, last_seen, query_hashes, days_seen of a state file; malformed parts become nulls and defaults."""
    schema = "files map<string, struct<count:int,last_seen:double,query_hashes:array<string>,days_seen:array<string>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")
    return raw.select(F.explode("files").alias("path", "m")).select("path", F.coalesce("m.count", F.lit(0)).alias("count"), F.coalesce("m.last_seen", F.lit(0.0)).alias("last_seen"), F.coalesce("m.query_hashes", F.array().cast("array<string>")).alias("query_hashes"), F.coalesce("m.days_seen", F.array().cast("array<string>")).alias("days_seen"))


def mask_env(servers: str | Column) -> Column:
    """Values of an environment map replaced by their names."""
    return F.transform_values(text.col(servers), lambda k, v: F.concat(F.lit("<env:"), k, F.lit(">")))


# -- sinks ------------------------------------------------------------------------------------------------------------


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the partitions that ``chunks`` has and no others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose keys are not in ``new``, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_archive(files_: DataFrame, path: str) -> None:
    """Texts, gzipped, one folder for each workspace."""
    files_.select("workspace", F.col("text").alias("value")).write.mode("append").partitionBy("workspace").option("compression", "gzip").text(path)


def write_audit(rows: DataFrame, path: str, operation: str, now: str) -> None:
    """Append one JSON line for each deletion: when, what, where, why, and a short preview."""
    rows.select(F.lit(now).alias("ts"), F.lit(operation).alias("op"), F.col("path").alias("file"), "reason", text.preview("text").alias("preview")).write.mode("append").json(path)
