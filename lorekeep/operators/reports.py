"""Roll-ups and rendered reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gate, paths, text
from ..sources import vault


def histogram(rows: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Values and their numbers, most frequent first."""
    return rows.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def workspace_rollup(files: DataFrame) -> DataFrame:
    return files.groupBy("workspace").agg(F.count("*").alias("n_files"), F.max("mtime").alias("last_touched"), F.sum("size").alias("bytes"))


def changelog(commits: DataFrame) -> DataFrame:
    """workspace, commits, types, topics, entries: a commit counts for each workspace it names; entry sums of 0 are left out."""
    t = F.col("trailers")
    names = F.transform(F.split(F.coalesce(t["Workspace"], F.nullif("scope", F.lit("")), F.lit("vault")), ","), lambda x: F.trim(x))
    topics = F.filter(F.transform(F.split(F.coalesce(t["Topics"], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    deltas = F.transform(F.regexp_extract_all(F.coalesce(t["Entries"], F.lit("")), F.lit(r"([+-]\d+)\s*([a-z-]+)"), 0), lambda m: F.struct(F.regexp_extract(m, r"([a-z-]+)$", 1).alias("kind"), F.regexp_extract(m, r"([+-]\d+)", 1).cast("int").alias("d")))
    rows = commits.select("type", F.explode(names).alias("workspace"), topics.alias("topics"), deltas.alias("deltas"))
    by_type = rows.groupBy("workspace", "type").agg(F.count("*").alias("n"))
    types = by_type.groupBy("workspace").agg(F.sum("n").alias("commits"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    topic = rows.select("workspace", F.explode("topics").alias("topic")).distinct().groupBy("workspace").agg(F.array_sort(F.collect_list("topic")).alias("topics"))
    sums = rows.select("workspace", F.explode("deltas").alias("x")).groupBy("workspace", "x.kind").agg(F.sum("x.d").alias("d")).filter("d <> 0")
    entry = sums.groupBy("workspace").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "d")))).alias("entries"))
    return types.join(topic, "workspace", "left").join(entry, "workspace", "left").orderBy("workspace")


def type_totals(commits: DataFrame) -> DataFrame:
    return histogram(commits, "type")


def change_counts(changes: DataFrame, added_lines: DataFrame) -> DataFrame:
    """One row: files, lines added and deleted, the three largest buckets and files, dates of the knowledge, tags of new entries."""
    rows = changes.withColumns({"bucket": paths.bucket("path"), "date": F.nullif(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})-[a-z0-9-]+\.md$", 1), F.lit(""))})
    top = lambda df, key, n: F.transform(F.slice(F.sort_array(F.collect_list(F.struct(F.col(n), F.col(key))), False), 1, 3), lambda x: x[key])
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n")).agg(top(rows, "bucket", "n").alias("top_buckets"))
    totals = rows.agg(F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    largest = rows.select("path", (F.col("added") + F.col("deleted")).alias("n")).orderBy(F.desc("n"), "path").limit(3).agg(top(rows, "path", "n").alias("top_files"))
    tags = added_lines.select(gate.known_tag("value").alias("tag")).filter("tag <> ''").groupBy("tag").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("tags"))
    return totals.crossJoin(buckets).crossJoin(largest).crossJoin(tags)  # one row each


def why(tags_added: Column, tags_removed: Column, goal: Column, decision: Column, because: Column, hypothesis: Column, change: Column) -> Column:
    """struct(why, code): the reason of a change from what it holds, first rule wins."""
    has = lambda m, t: F.coalesce(F.try_element_at(m, F.lit(t)), F.lit(0)) > 0
    rule = lambda t, code: F.struct(F.substring(t if isinstance(t, Column) else F.lit(t), 1, 160).alias("why"), F.lit(code).alias("code"))
    set_ = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(has(tags_removed, "hypothesis") & has(tags_added, "ref"), rule("a hypothesis has become a verified reference", "verify-claim"))
        .when(set_(goal), rule(F.concat(F.lit("objective: "), goal), "capture-objective"))
        .when(set_(decision) & set_(because), rule(F.concat(decision, F.lit(" ("), because, F.lit(")")), "record-decision"))
        .when(set_(decision), rule(F.concat(F.lit("decision: "), decision), "record-decision"))
        .when(set_(because), rule(because, "record-decision"))
        .when(set_(hypothesis), rule(F.concat(F.lit("unverified: "), hypothesis), "log-hypothesis"))
        .when(change == "archive", rule("raw journals past their time", "forget-stale"))
        .when(change == "prune", rule("superseded or duplicate entries", "prune-stale"))
        .when(change == "consolidate", rule("topic index rebuilt", "rebuild-moc"))
        .when(has(tags_added, "ref"), rule("a verified finding", "record-finding"))
        .when(has(tags_added, "goal"), rule("a new objective", "capture-objective"))
        .when(change == "add", rule("knowledge of this session", "capture"))
        .otherwise(rule("existing knowledge revised", "revise"))
    )


def aspect_preview(t: str | Column, most: int = 120) -> Column:
    """The first telling line of a file."""
    body = text.lines(vault.body(t))
    useful = F.filter(F.transform(body, lambda l: F.trim(F.regexp_replace(l, r"^[#>*\-\s]+", ""))), lambda l: (l != "") & ~l.startswith("---"))
    return F.substring(F.coalesce(F.get(useful, F.lit(0)), F.lit("")), 1, most)


def topic_index(aspects: DataFrame) -> DataFrame:
    """workspace, topic, listing: a line for each dated file, newest first."""
    line = F.struct("aspect_date", paths.name("path").alias("name"), F.concat(F.lit("- "), paths.name("path"), F.lit(": "), aspect_preview("text")).alias("line"))
    return aspects.groupBy("workspace", "topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line), asc=False), lambda x: x["line"]), "\n").alias("listing"), F.count("*").alias("n_aspects"))


def section_of(t: str | Column, heading: str) -> Column:
    """The text under a heading to before the next of its level or above."""
    level = len(heading) - len(heading.lstrip("#"))
    return F.trim(F.regexp_extract(text.col(t), rf"(?ms)^\Q{heading}\E[^\n]*\n(.*?)(?=^#{{1,{level}}}\s|\z)", 1))


def score_trend(scores: DataFrame, by: str = "sid", order: str = "turn", column: str = "score") -> DataFrame:
    """``scores`` with trend: declining over three rows, stuck at two or less, or steady."""
    w = Window.partitionBy(by).orderBy(order)
    one, two = F.lag(column, 1).over(w), F.lag(column, 2).over(w)
    return scores.withColumn("trend", F.when((F.col(column) < one) & (one < two), "declining").when((F.col(column) <= 2) & (one <= 2) & (two <= 2), "stuck").otherwise("steady"))


def promoted_lines(ranked: DataFrame, n: int = 5) -> DataFrame:
    """The best and the worst few of a ranking as lines."""
    line = F.concat(F.lit("- "), "path", F.lit(" ("), F.format_number("score", 3), F.lit(")"))
    best = ranked.filter("verdict = 'promote'").orderBy(F.desc("score"), "path").limit(n).select(F.lit("promote").alias("part"), line.alias("line"))
    worst = ranked.filter("verdict = 'prune'").orderBy("score", "path").limit(n).select(F.lit("prune").alias("part"), line.alias("line"))
    return best.unionByName(worst)


def dream_totals(phases: DataFrame) -> DataFrame:
    """Sums over workspaces of what each phase did; skipped and failed ones are only counted."""
    done = F.col("status") == "ok"
    return phases.groupBy("phase").agg(F.count_if(done).alias("workspaces"), F.sum(F.when(done, F.col("n")).otherwise(0)).alias("n"), F.count_if(~done).alias("skipped"))


#: Fixed value: from here on a rendered file is written by hand and stays as it is.
MANUAL = "## Cross-links (manual)"


def manual_block(t: str | Column) -> Column:
    """The part of a rendered file that is written by hand, empty without one."""
    at = F.instr(text.col(t), F.lit(MANUAL))
    return F.when(at > 0, F.substring(text.col(t), at, F.length(text.col(t)))).otherwise("")


def registry(files: DataFrame) -> DataFrame:
    """One row: text of the register of workspaces, a line for each with its files, topics and last day."""
    rows = files.groupBy("workspace").agg(F.count("*").alias("n"), F.count_distinct(paths.slug("path")).alias("topics"), F.max("mtime").alias("mtime"))
    day = F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd")
    line = F.concat(F.lit("| "), "workspace", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("topics").cast("string"), F.lit(" | "), day, F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("workspace", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.agg(F.concat(F.lit("# Workspaces\n\n| workspace | files | topics | last touched |\n|---|---|---|---|\n"), body, F.lit("\n\n")).alias("text"))


def to_write(rendered: DataFrame, stored: DataFrame, default_manual: str = f"{MANUAL}\n") -> DataFrame:
    """path, text of rendered files (path, text) that differ from what is stored but for the line last_touched.

    The part written by hand is kept from the stored file.
    """
    touched = lambda c: F.regexp_replace(c, r"(?m)^last_touched:.*$", "last_touched:")
    both = rendered.join(stored.select("path", F.col("text").alias("was")), "path", "left")
    manual = F.coalesce(F.nullif(manual_block("was"), F.lit("")), F.lit(default_manual))
    return both.withColumn("text", F.concat("text", manual)).filter(F.col("was").isNull() | (touched(F.col("text")) != touched(F.col("was")))).select("path", "text")


def conflict_previews(files: DataFrame, lines: int = 30) -> DataFrame:
    """path, preview: the first lines of the files with conflict markers."""
    return files.filter(text.has_conflict_markers("text")).select("path", F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n").alias("preview"))
