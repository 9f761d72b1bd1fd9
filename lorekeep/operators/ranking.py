"""Ranking and budgets: activity signals, context plans, allocations, newest-K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, scores, text

SIGNALS = tuple(scores.SIGNAL_WEIGHTS)
ROOM = 200


def signals(activity: DataFrame, now: float, richness: Column | None = None) -> DataFrame:
    """path and the six raw signals of activity (path, count, last_seen, query_hashes, days_seen)."""
    days = F.when(F.size("days_seen") > 0, F.size("days_seen")).otherwise(1)
    return activity.select(
        "path", F.col("count").cast("double").alias("frequency"), (F.col("count") / days).alias("relevance"), F.size(F.array_distinct("query_hashes")).cast("double").alias("diversity"),
        scores.weekly_decay("last_seen", now).alias("recency"), F.size(F.array_distinct("days_seen")).cast("double").alias("consolidation"), (F.lit(0) if richness is None else richness).cast("double").alias("richness"),
    )


def signals_of_events(events: DataFrame, now: float, path: str = "path", query: str = "query", at: str = "at") -> DataFrame:
    """The same signals from raw events; days are distinct by nature here."""
    day = F.to_date(F.timestamp_seconds(F.col(at)))
    g = events.groupBy(path).agg(F.count("*").cast("double").alias("frequency"), F.countDistinct(query).cast("double").alias("diversity"), F.countDistinct(day).cast("double").alias("consolidation"), F.max(at).alias("last_seen"))
    return g.select(F.col(path).alias("path"), "frequency", (F.col("frequency") / F.greatest("consolidation", F.lit(1.0))).alias("relevance"), "diversity", scores.weekly_decay("last_seen", now).alias("recency"), "consolidation", F.lit(0.0).alias("richness"))


def rank_signals(raw: DataFrame, least_count: int = 2) -> DataFrame:
    """``raw`` with score and verdict: signals divided by their largest value (1 if that is not positive), weighted and summed."""
    rows = raw.filter(F.col("frequency") >= least_count)
    top = rows.agg(*(F.max(c).alias(f"max_{c}") for c in SIGNALS))
    rows = rows.crossJoin(F.broadcast(top))  # one row
    score = F.lit(0.0)
    for c, w in scores.SIGNAL_WEIGHTS.items():
        score = score + F.lit(w) * (F.col(c) / F.when(F.col(f"max_{c}") > 0, F.col(f"max_{c}")).otherwise(1.0))
    return rows.withColumn("score", score).drop(*(f"max_{c}" for c in SIGNALS)).withColumn("verdict", scores.verdict("score"))


def budget_scores(files: DataFrame, query: str, now: float, today: str, half_life: float = 14, head: int = 4000) -> DataFrame:
    """``files`` with head, tier, score > 0: lexical likeness x tier weight x (a half + half the recency)."""
    rows = files.withColumns({"head": F.substring("text", 1, head), "tier": paths.tier("path", today)}).filter(text.squeeze("head") != "")
    lexical = text.jaccard(text.char_ngrams(F.lit(query)), text.char_ngrams("head")) if query.strip() else F.lit(0.5)
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in scores.TIER_WEIGHTS.items() for x in kv)), F.col("tier")), F.lit(0.5))
    return text.computed_once(rows, "score", lexical * weight * (0.5 + 0.5 * scores.half_life_decay("mtime", now, half_life))).filter("score > 0")


def fill(rows: DataFrame, budget: int, order: list, length: str | Column, room: int = ROOM, by: list[str] | None = None) -> DataFrame:
    """``rows`` with take: lengths in order until ``room`` or less is left; the last one is cut to what is left.

    A cut item uses the budget up, so running sums say the same as a loop.  Without ``by`` the order is one for all
    rows and only the first budget / (shortest useful length) rows can matter: ``head_rows`` bounds them before.
    """
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    n = text.col(length).cast("long")
    left = F.lit(budget) - F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__left", left).filter(F.col("__left") > room).withColumn("take", F.least(n, F.col("__left"))).drop("__left")


def head_rows(rows: DataFrame, budget: int, order: list) -> DataFrame:
    """The first rows that a budget can reach when every row takes at least one character."""
    return rows.orderBy(*order).limit(budget)


def plan_context(files: DataFrame, query: str, now: float, today: str, budget: int = 15_000, prefix: DataFrame | None = None) -> DataFrame:
    """path, snippet, score, part (0 prefix, 1 scored), in order: the fixed prefix first, then the best that fit."""
    out = None
    scored = budget_scores(files, query, now, today)
    if prefix is not None:
        fixed = files.join(F.broadcast(prefix), "path").filter(text.squeeze("text") != "").withColumn("head", F.substring("text", 1, budget))
        out = fill(fixed, budget, ["ord"], F.length("head")).select("path", F.expr("substring(head, 1, take)").alias("snippet"), F.lit(1.0).alias("score"), F.lit(0).alias("part"))
        scored = scored.join(F.broadcast(prefix.select("path")), "path", "left_anti")
        spent = out.agg(F.coalesce(F.sum(F.length("snippet")), F.lit(0)).alias("used")).first()["used"]
    else:
        spent = 0
    best = head_rows(scored, budget, [F.desc("score"), "path"])
    rest = fill(best, budget - spent, [F.desc("score"), "path"], F.length("head")).select("path", F.expr("substring(head, 1, take)").alias("snippet"), "score", F.lit(1).alias("part"))
    return rest if out is None else out.unionByName(rest)


def allocate(files: DataFrame, total: int = 15_000, per_file: int = 4_000, by: str = "plan") -> DataFrame:
    """``files`` (by, ord, is_delta, chars) with want, take, status: deltas are reserved, statics get the rest in order, deltas what is left."""
    want = F.least("chars", F.lit(per_file))
    rows = files.withColumn("want", want)
    reserved = F.sum(F.when(F.col("is_delta"), F.col("want")).otherwise(0)).over(Window.partitionBy(by))
    part = Window.partitionBy(by, "is_delta").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("want").over(part), F.lit(0))
    rows = rows.withColumns({"__reserved": reserved, "__before": before})
    static = F.greatest(F.lit(0), F.least("want", F.greatest(F.lit(0), F.lit(total) - F.col("__reserved")) - F.col("__before")))
    rows = rows.withColumn("take", F.when(~F.col("is_delta"), static))
    given = F.coalesce(F.sum("take").over(Window.partitionBy(by)), F.lit(0))
    delta = F.greatest(F.lit(0), F.least(F.col("want"), F.lit(total) - given - F.col("__before")))
    rows = rows.withColumn("take", F.when(F.col("is_delta"), delta).otherwise(F.col("take")))
    status = F.when((F.col("take") == 0) & (F.col("chars") > 0), "DROPPED").when(F.col("take") < F.col("chars"), "truncated").otherwise("full")
    return rows.withColumn("status", status).drop("__reserved", "__before")


def tail_budget(turns: DataFrame, most: int, by: list[str], order: str, length: str | Column) -> DataFrame:
    """The newest turns of each group that fit ``most`` characters; the newest always stays."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    total = F.sum(text.col(length)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumns({"__sum": total, "__n": F.row_number().over(w)}).filter((F.col("__sum") <= most) | (F.col("__n") == 1)).drop("__sum", "__n")


def keep_newest(rows: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    """``rows`` with is_newest: among the first k of their group."""
    return rows.withColumn("is_newest", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= k)
