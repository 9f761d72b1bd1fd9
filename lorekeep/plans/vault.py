"""The tables as a vault: how documents, events and conversations stand for files, activity and transcripts.

Every mapping is here twice, as DataFrames and as SQL text, so that queries and their SQL start from the same rows.
Moments are literals: nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gate
from ..operators import lines

NOW, TODAY = 1721347200.0, "2024-07-19"
EVENTS_NOW = 1706659200.0  # 2024-01-31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, workspace (source), topic (lang), aspect_date, path, mtime, size, text of documents."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int"))
    rows = d.select("doc_id", F.col("source").alias("workspace"), F.col("lang").alias("topic"), day.alias("aspect_date"), F.coalesce("text", F.lit("")).alias("text"))
    path = F.concat(F.lit("workspaces/"), "workspace", F.lit("/"), "topic", F.lit("/"), F.date_format("aspect_date", "yyyy-MM-dd"), F.lit("-doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    return rows.select("doc_id", "workspace", "topic", "aspect_date", path.alias("path"), F.unix_seconds(F.col("aspect_date").cast("timestamp")).cast("double").alias("mtime"), F.length("text").alias("size"), "text")


FILES = r"""
files AS (
  SELECT doc_id, workspace, topic, aspect_date, 'workspaces/' || workspace || '/' || topic || '/' || strftime(aspect_date, '%Y-%m-%d') || '-doc-' || doc_id || '.md' AS path,
    epoch(aspect_date)::DOUBLE AS mtime, length(text)::INTEGER AS size, text
  FROM (SELECT doc_id, source AS workspace, lang AS topic, (DATE '2024-01-01' + (doc_id % 200)::INTEGER) AS aspect_date, coalesce(text, '') AS text FROM documents))"""


def nine_tag(n):
    """The tag by number."""
    return F.element_at(F.array(*map(F.lit, gate.TAGS)), (n % 9 + 1).cast("int"))


TAG_LIST = "[" + ", ".join(f"'{t}'" for t in gate.TAGS) + "]"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, doc_id, path, workspace, topic, mtime, ci, heading (language), content, tag, keywords (source)."""
    cut = lines.chunks(files(spark, sf_dir).drop("size", "aspect_date"))
    return cut.select((F.col("doc_id") * 1000 + F.col("ci")).alias("chunk_id"), "doc_id", "path", "workspace", "topic", "mtime", "ci", F.col("topic").alias("heading"), "content", nine_tag(F.col("doc_id")).alias("tag"), F.col("workspace").alias("keywords"))


CHUNKS = FILES + rf""",
stripped AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM files),
chunks AS (
  SELECT doc_id * 1000 + i AS chunk_id, doc_id, path, workspace, topic, mtime, i AS ci, topic AS heading, substr(body, i * 1500 + 1, 1500) AS content,
    ({TAG_LIST})[(doc_id % 9 + 1)::INTEGER] AS tag, workspace AS keywords
  FROM (SELECT *, unnest(range(0, (length(body) - 1) // 1500 + 1))::INTEGER AS i FROM stripped WHERE body <> ''))"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, workspace, topic, line (from 1), tag, text of every line, as ``- [tag] line``."""
    rows = files(spark, sf_dir).select("doc_id", "path", "workspace", "topic", F.posexplode(F.split("text", "\n")).alias("k", "l"))
    tag = nine_tag(F.col("doc_id") + F.col("k"))
    return rows.filter(F.trim("l") != "").select("doc_id", "path", "workspace", "topic", (F.col("k") + 1).alias("line"), tag.alias("tag"), F.concat(F.lit("- ["), tag, F.lit("] "), "l").alias("text"))


ENTRIES = FILES + rf""",
split AS (SELECT doc_id, path, workspace, topic, string_split(text, chr(10)) AS ls FROM files),
numbered AS (SELECT doc_id, path, workspace, topic, unnest(range(1, len(ls) + 1))::INTEGER AS line, unnest(ls) AS l FROM split),
entries AS (
  SELECT doc_id, path, workspace, topic, line, ({TAG_LIST})[((doc_id + line - 1) % 9 + 1)::INTEGER] AS tag, '- [' || ({TAG_LIST})[((doc_id + line - 1) % 9 + 1)::INTEGER] || '] ' || l AS text
  FROM numbered WHERE trim(l) <> '')"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text of conversations."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (user), query (type), at (epoch seconds), event_id, value of events."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("query"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")


EVENTS = r"""
ev AS (SELECT event_id, 'user-' || user_id AS path, event_type AS query, epoch_us(ts) / 1e6 AS at_s, ts, user_id, value FROM events)"""
