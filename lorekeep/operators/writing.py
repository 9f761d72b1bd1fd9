"""What writing would do: lessons, tag backfill, commit messages, bootstrap reports, dreams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gate, paths, privacy, scores, text
from ..sources import vault
from . import joins, lines, ranking, reports, tags

LESSON = ("symptom", "tried", "cause", "fix", "source")


def lessons_of(rows: DataFrame, column: str = "text") -> DataFrame:
    """``rows`` with the five fields of one-line lessons (``a -- b -- c -- d [-- e]``); other lines are left out."""
    parts = text.lesson_parts(column)
    return rows.withColumn("__p", parts).filter("__p is not null").select(*rows.columns, *(F.col("__p")[i].alias(name) for i, name in enumerate(LESSON)))


def lesson_text(date: str) -> Column:
    """A lesson as it is stored, newest ones first in their file."""
    shown = [F.concat(F.lit(f"**{name.capitalize()}:** "), F.coalesce(F.col(name), F.lit(""))) for name in LESSON]
    return F.concat(F.lit(f"## {date}: "), text.truncate("symptom"), F.lit("\n"), F.concat_ws("\n", *shown))


def append_lessons(rows: DataFrame, topics: DataFrame, chunks: DataFrame, date: str, key: str = "id") -> DataFrame:
    """key, slug, status, reason, text for lessons (key and the five fields)."""
    body = rows.withColumn("text", lesson_text(date))
    routed = joins.duplicates(joins.route(body, topics, key=key), chunks)
    reason = gate.lesson_reason("symptom", F.concat_ws("\n", "tried", "cause", "fix", "source"))
    status = F.when(F.col("is_duplicate"), "duplicate").when(reason.isNotNull(), "rejected").otherwise("written")
    return routed.select(key, "slug", status.alias("status"), F.when(~F.col("is_duplicate"), reason).alias("reason"), privacy.sanitize("text")["text"].alias("text"))


def tag_backfill(files: DataFrame, most: int = 15) -> DataFrame:
    """path, old, new for files whose entries' tags are not all in their header: what a backfill would write."""
    entries = files.select("path", F.explode(lines.entry_blocks("text")).alias("e")).select("path", tags.extract_tags(F.col("e.text")).alias("t"))
    found = entries.select("path", F.explode("t").alias("tag")).groupBy("path", "tag").agg(F.count("*").alias("n"))
    ranked = found.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))), lambda x: x["tag"]).alias("found"))
    rows = files.join(ranked, "path").withColumn("old", vault.front_tags("text"))
    return rows.withColumn("new", text.merge_tags("old", "found", most)).filter(F.col("new") != F.col("old")).select("path", "old", "new")


def titles(added: DataFrame) -> DataFrame:
    """One row: the first goal, decision, hypothesis and rationale among added lines (i, value)."""
    title = lambda tag: F.trim(F.regexp_extract(F.trim("value"), rf"(?i)^(?:#{{2,6}}\s*|[-*]\s*)?\[{tag}\]\s*(.+)", 1))
    because = F.regexp_extract("value", r"(?i)(?:^|[^\p{L}\p{N}_])((?:because|since|so that|in order to|due to|vì|bởi|để)\s+\S.*)", 1)
    first = lambda c: F.min_by(c, F.when(c != "", F.col("i")))
    return added.agg(first(title("goal")).alias("goal"), first(title("decision")).alias("decision"), first(title("hypothesis")).alias("hypothesis"), first(because).alias("because"))


def commit_message(changes: DataFrame, added: DataFrame, removed: DataFrame, change: str = "update") -> DataFrame:
    """One row: subject (72 characters at most), body with workspaces, topics, entries and the reason."""
    counts = reports.change_counts(changes, added)
    tag_map = lambda df, n: df.select(gate.known_tag("value").alias("tag")).filter("tag <> ''").groupBy("tag").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias(n))
    ws = changes.filter("path like 'workspaces/%'").agg(F.array_join(F.array_sort(F.collect_set(paths.workspace("path"))), ", ").alias("ws"), F.array_join(F.slice(F.array_sort(F.collect_set(paths.slug("path"))), 1, 8), ", ").alias("topics"))
    row = counts.crossJoin(tag_map(removed, "gone")).crossJoin(titles(added)).crossJoin(ws)  # one row each
    why = reports.why(F.col("tags"), F.col("gone"), F.col("goal"), F.col("decision"), F.col("because"), F.col("hypothesis"), F.lit(change))
    scope = F.coalesce(F.nullif("ws", F.lit("")), F.lit("vault"))
    subject = F.substring(F.concat(F.lit(f"{change}("), scope, F.lit("): "), F.array_join("top_buckets", ", "), F.lit(" in "), F.col("files").cast("string"), F.lit(" files")), 1, 72)
    deltas = lambda c, sign: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(F.lit(sign), e["value"].cast("string"), F.lit(" "), e["key"])), " ")
    body = F.concat_ws("\n", F.concat(F.lit("Why: "), why["why"]), F.concat(F.lit("Code: "), why["code"]), F.concat(F.lit("Workspace: "), scope), F.concat(F.lit("Topics: "), F.col("topics")), F.concat(F.lit("Entries: "), F.trim(F.concat_ws(" ", deltas("tags", "+"), deltas("gone", "-")))))
    return row.select(subject.alias("subject"), body.alias("body"))


def bootstrap_report(files: DataFrame, total: int = 15_000, per_file: int = 4_000) -> DataFrame:
    """plan, ord, path, take, status, line of an allocation."""
    a = ranking.allocate(files, total, per_file)
    return a.select("plan", "ord", "path", "take", "status", F.concat("path", F.lit(": "), F.col("take").cast("string"), F.lit("/"), F.col("chars").cast("string"), F.lit(" "), "status").alias("line"))


def dream(activity: DataFrame, files: DataFrame, now: float) -> DataFrame:
    """workspace, candidates, promote, maintain, prune, status: consolidation of each workspace on its own scale."""
    rich = files.select("path", lines.typed_entry_count("text").alias("rich"))
    rows = ranking.signals(activity.join(rich, "path"), now, F.col("rich")).filter("frequency >= 2").withColumn("workspace", paths.workspace("path"))
    w = Window.partitionBy("workspace")
    score = F.lit(0.0)
    for c, weight in scores.SIGNAL_WEIGHTS.items():
        top = F.max(c).over(w)
        score = score + F.lit(weight) * (F.col(c) / F.when(top > 0, top).otherwise(1.0))
    judged = rows.withColumn("verdict", scores.verdict(score))
    done = judged.groupBy("workspace").agg(F.count("*").alias("candidates"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("promote", "maintain", "prune")))
    every = files.select("workspace").distinct()
    return every.join(done, "workspace", "left").fillna(0).withColumn("status", F.when(F.col("candidates") > 0, "ok").otherwise("no_candidates"))


def append_blocks(logs: DataFrame, blocks: DataFrame, order: str = "ord") -> DataFrame:
    """path, text, redactions of logs (path, text) after blocks (path, ord, block) are appended, in order, each on lines of its own.

    Logs that are not there yet begin with their first block.  What is written is redacted as a whole.
    """
    block = F.concat(F.when(F.col("block").startswith("\n"), "").otherwise("\n"), "block", F.when(F.col("block").endswith("\n"), "").otherwise("\n"))
    added = blocks.withColumn("block", block).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "block"))), lambda b: b["block"]), "").alias("added"))
    both = added.join(logs.select("path", F.col("text").alias("was")), "path", "left")
    return both.select("path", privacy.sanitize(F.concat(F.coalesce("was", F.lit("")), "added")).alias("s")).select("path", F.col("s.text").alias("text"), F.col("s.n").alias("redactions"))


def hook_output(decision: str | Column, reason: str | Column, context: str | Column | None = None) -> Column:
    """The JSON answer to a hook: decision and reason, and the additional context if there is one."""
    fields = [text.col(decision).alias("decision"), text.col(reason).alias("reason")]
    return F.to_json(F.struct(*fields, *([] if context is None else [text.col(context).alias("additionalContext")])))
