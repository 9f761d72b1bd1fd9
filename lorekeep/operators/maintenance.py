"""Retention and upkeep: pruning, forgetting, handoff rotation, backlog, validation, research gate, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, paths, text
from ..sources import vault
from . import index, joins, lines, ranking

DAY = 86400


def expired(entry: str | Column, today: str) -> Column:
    """A valid-until date before today; dates compare as text."""
    until = F.regexp_extract(text.col(entry), r"(?i)valid[_-]?until:\s*(\d{4}-\d{2}-\d{2})", 1)
    return (until != "") & (until < today)


def superseded(entry: str | Column) -> Column:
    return text.col(entry).rlike(r"(?i)\((?:superseded|deprecated|obsolete)\b")


def prune(entries: DataFrame, today: str, threshold: float = 0.85, group: str = "path", order: str = "line") -> DataFrame:
    """``entries`` (group, order, text) with reason: expired, superseded, duplicate-newer-dropped, or null for kept ones."""
    rows = entries.withColumn("reason", F.when(expired("text", today), "expired").when(superseded("text"), "superseded"))
    kept = joins.greedy_keep(rows.filter("reason is null").drop("reason"), threshold, group, order)
    alive = kept.withColumn("reason", F.when(~F.col("kept"), "duplicate-newer-dropped")).drop("kept")
    return rows.filter("reason is not null").unionByName(alive.select(*rows.columns))


def journal_candidates(files: DataFrame, now: float, today: str, ttl_days: int = 7, max_bytes: int = 75_000) -> DataFrame:
    """Journals to archive: past their time, or too large and older than a day; never ``_`` files nor today's."""
    name = paths.name("path")
    age = F.lit(now) - F.col("mtime")
    return files.filter(~name.startswith("_") & (name != f"{today}.md") & ((age > ttl_days * DAY) | ((F.col("size") > max_bytes) & (age > DAY))))


def aspect_candidates(files: DataFrame, today: str, threshold_days: int = 90, keep: int = 3, by: tuple[str, ...] = ("workspace", "topic")) -> DataFrame:
    """Dated files older than the threshold that are not among the newest of their topic."""
    ranked = ranking.keep_newest(files.filter(F.col("aspect_date").isNotNull()), keep, list(by), F.desc(paths.name("path")), F.desc("path"))
    return ranked.filter(~F.col("is_newest") & (dates.days_before("aspect_date", today) > threshold_days)).drop("is_newest")


def forget(files: DataFrame, candidates: DataFrame, stored: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries to salvage from the candidates, the files that stay)."""
    rows = candidates.select("path", F.explode(lines.entry_blocks("text")).alias("e")).select("path", F.col("e.line").alias("line"), F.col("e.text").alias("text"))
    return joins.salvage(rows, stored, whole=whole), files.join(candidates.select("path"), "path", "left_anti")


def rotate_handoff(handoffs: DataFrame, today: str, keep: int = 10, stale_days: int = 14) -> DataFrame:
    """path, i, text, archived of the sections: all but the newest dated ones go, undated ones stay; bullets that went stale are listed."""
    parts = handoffs.select("path", F.explode(lines.h2_sections("text")).alias("s")).select("path", "s.i", "s.text")
    keyed = parts.withColumn("key", F.when(F.col("i") > 0, dates.section_key("text")))
    w = Window.partitionBy("path").orderBy(F.desc("key"), "i")
    ranked = keyed.withColumn("n", F.when(F.col("key").isNotNull(), F.row_number().over(w)))
    stale = F.filter(lines.host_bullets("text"), lambda b: (F.coalesce(dates.days_before(dates.first_date(b["text"]), today), F.lit(0)) > stale_days) & ~F.split(b["text"], "\n", 2)[0].rlike(lines.LIVE))
    return ranked.withColumn("archived", F.coalesce(F.col("n") > keep, F.lit(False))).withColumn("stale", F.transform(stale, lambda b: b["text"])).select("path", "i", "text", "archived", "stale")


def backlog(transcripts: DataFrame, ledger: DataFrame, now: float, least_bytes: int = 20_000, idle_minutes: int = 60) -> DataFrame:
    """Transcripts to review, oldest first: large enough, idle, not in the ledger."""
    rows = transcripts.filter((F.col("size") >= least_bytes) & (F.col("mtime") <= now - idle_minutes * 60))
    return joins.unreviewed(rows, ledger).orderBy("mtime", "sid")


def next_review(backlog_: DataFrame, least_turns: int = 10) -> DataFrame:
    """sid, status of the next one: the first with enough assistant turns, and the thinner ones before it, to be skipped."""
    enough = F.col("assistant_turns") >= least_turns
    first = backlog_.filter(enough).agg(F.min(F.struct("mtime", "sid")).alias("first"))
    rows = backlog_.crossJoin(F.broadcast(first)).withColumn("me", F.struct("mtime", "sid"))  # one row
    return rows.filter(F.col("first").isNull() | (F.col("me") <= F.col("first"))).select("sid", F.when(enough, "next").otherwise("skipped-thin").alias("status"))


def mark(ledger: DataFrame, marks: DataFrame) -> DataFrame:
    """The ledger after marks: sid, status, at, note; the last mark of a session counts."""
    last = marks.groupBy("sid").agg(F.max_by(F.struct("status", "at", "note"), "at").alias("m")).select("sid", "m.*")
    return vault.upsert(ledger, last, ["sid"])


# -- validation -------------------------------------------------------------------------------------------------------

REQUIRED = {"moc": ("slug", "title", "type", "status"), "aspect": ("type", "date", "topic", "slug", "title")}


def simple_front(t: str | Column) -> Column:
    """The validator's own reading of a header: scalars as they stand, null without a header."""
    block = F.regexp_extract(text.col(t), r"(?s)\A---(.*?)\n---", 1)
    rows = F.filter(F.split(block, "\n"), lambda l: l.rlike(r"^[a-zA-Z_][\w-]*:"))
    entries = F.transform(rows, lambda l: F.struct(F.regexp_extract(l, r"^([a-zA-Z_][\w-]*):", 1), F.trim(F.regexp_extract(l, r"^[^:]+:\s*(.*)$", 1))))
    return F.when(text.col(t).rlike(r"(?s)\A---.*?\n---"), F.map_from_entries(vault.last_by_key(entries, "col1")))


def issues(path: str | Column, t: str | Column) -> Column:
    """array<string> of what is wrong with a file, in order; empty for files out of scope."""
    kind, front = paths.kind(path), simple_front(t)
    topic, aspect = paths.folder(path), paths.aspect_name(path)
    blank = lambda f: F.coalesce(front[f], F.lit("")) == ""
    headed = kind.isin("moc", "aspect")
    checks = [
        F.when((kind == "aspect") & ~aspect.rlike(text.SLUG), F.concat(F.lit("bad-aspect-slug:"), aspect)),
        F.when(~topic.rlike(text.SLUG), F.concat(F.lit("bad-topic-slug:"), topic)),
        F.when((kind == "lessons") & ~text.col(t).contains("## "), "lessons-no-entries"),
        F.when(headed & front.isNull(), "missing-frontmatter"),
        *(F.when((kind == k) & front.isNotNull() & blank(f), f"missing-field:{f}") for k, fields in REQUIRED.items() for f in fields),
        F.when((kind == "aspect") & ~blank("type") & (front["type"] != "aspect"), F.concat(F.lit("wrong-type:"), front["type"], F.lit("!=aspect"))),
    ]
    return F.when(kind.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))


def fixed_front(path: str | Column, t: str | Column) -> Column:
    """The header of an aspect with what its path tells filled in."""
    front = F.coalesce(vault.front(t), F.create_map().cast("map<string,string>"))
    slug = F.regexp_replace(F.substring(paths.aspect_name(path), 1, 60), "-+$", "")
    derived = F.create_map(F.lit("type"), F.lit("aspect"), F.lit("date"), F.regexp_extract(paths.name(path), paths.DATED_ASPECT, 1), F.lit("topic"), paths.folder(path), F.lit("slug"), slug, F.lit("title"), F.initcap(F.regexp_replace(slug, "-", " ")))
    have = F.map_filter(front, lambda k, v: v != "")
    return F.map_concat(F.map_filter(derived, lambda k, v: ~F.map_contains_key(have, k)), have)


def research_status(notes: DataFrame, distilled: DataFrame, limit: int = 800) -> DataFrame:
    """topic, raw_count, missing_refs, distilled_words, issues, passed for each research topic."""
    raw = notes.groupBy("topic").agg(F.count("*").alias("raw_count"), F.array_sort(F.collect_list(F.when(~text.has_source_ref("text"), paths.name("path")))).alias("missing_refs"))
    done = distilled.select("topic", text.word_count("text").alias("distilled_words"))
    rows = raw.join(done, "topic", "full_outer").fillna(0, ["raw_count"]).withColumn("missing_refs", F.coalesce("missing_refs", F.array().cast("array<string>")))
    found = F.array(
        F.when(F.col("raw_count") < 1, "no-raw-note"), F.when(F.size("missing_refs") > 0, F.concat(F.lit("missing-refs:"), F.array_join("missing_refs", ","))),
        F.when(F.col("distilled_words").isNull(), "no-distilled").when(F.col("distilled_words") >= limit, "distilled-too-long"),
    )
    return rows.withColumn("issues", F.filter(found, lambda x: x.isNotNull())).withColumn("passed", F.size("issues") == 0)


# -- migration --------------------------------------------------------------------------------------------------------


def migration_plan(files: DataFrame) -> DataFrame:
    """src, action, dst of the move from flat and folder notes to topic folders."""
    act, inner = paths.migration_action("path"), paths.inner("path")
    ws = F.concat(F.lit("workspaces/"), F.col("workspace"), F.lit("/"))
    stem = F.regexp_replace(paths.name("path"), r"\.md$", "")
    day = F.date_format(dates.day_of("mtime"), "yyyy-MM-dd")
    parent = F.regexp_replace("path", "/[^/]+$", "")
    dst = (
        F.when(act == "flat-to-folder", F.concat(ws, stem, F.lit(f"/{paths.README}")))
        .when(act == "folder-note-to-readme", F.concat(parent, F.lit(f"/{paths.README}")))
        .when(act.isin("sibling-to-aspect", "nested-to-aspect"), F.concat(ws, F.split(inner, "/")[0], F.lit("/"), day, F.lit("-"), stem, F.lit(".md")))
    )
    return files.select(F.col("path").alias("src"), act.alias("action"), dst.alias("dst"))


def merge_moves(plan: DataFrame, files: DataFrame) -> DataFrame:
    """dst, text: files that move to one place, in order of their paths, each line once."""
    moved = plan.filter("dst is not null").join(files.select(F.col("path").alias("src"), "text"), "src")
    rows = moved.select("dst", "src", F.posexplode(text.lines(vault.body("text"))).alias("i", "line"))
    keyed = rows.withColumn("copy", F.when(F.trim("line") == "", F.concat_ws(":", "src", F.col("i").cast("string"))).otherwise(F.lit("")))  # blank lines stay
    once = index.first_wins(keyed, ["dst", "line", "copy"], "src", "i")
    return once.groupBy("dst").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "i", "line"))), lambda r: r["line"]), "\n").alias("text"))


def verify_moves(plan: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """src, dst, same: whether each single move kept the body, by SHA-256 without the header."""
    h = lambda df, p: df.select(F.col("path").alias(p), F.sha2(vault.body("text"), 256).alias(f"h_{p}"))
    single = plan.filter("dst is not null").withColumn("n", F.count("*").over(Window.partitionBy("dst"))).filter("n = 1").drop("n")
    return single.join(h(before, "src"), "src").join(h(after, "dst"), "dst", "left").select("src", "dst", F.coalesce(F.col("h_src") == F.col("h_dst"), F.lit(False)).alias("same"))


def prune_backups(backups: DataFrame, now: float) -> DataFrame:
    """``backups`` (path, mtime) with keep: the newest two, the second only while the newest is within a day."""
    w = Window.orderBy(F.desc("mtime"), "path")
    ranked = backups.orderBy(F.desc("mtime"), "path").limit(3).withColumn("n", F.row_number().over(w))  # a handful of rows
    newest = F.max("mtime").over(Window.partitionBy(F.lit(0)))
    keep = ranked.withColumn("keep", (F.col("n") == 1) | ((F.col("n") == 2) & (F.lit(now) - newest <= DAY))).select("path", "keep")
    return backups.join(F.broadcast(keep), "path", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
