"""Queries of ranking, budgets, transcripts, keyed state and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import maintenance, ranking, reports, transcripts
from ..sources import gitlog
from ..session import delete_at_exit, shared_folder
from ..streaming import event_time, state
from . import vault

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_SIGNALS = "WITH " + vault.EVENTS + r""",
g AS (SELECT path, count(*)::DOUBLE AS frequency, count(DISTINCT query)::DOUBLE AS diversity, count(DISTINCT ts::DATE)::DOUBLE AS consolidation, max(at_s) AS last_seen FROM ev GROUP BY path),
raw AS (SELECT path, frequency, frequency / greatest(consolidation, 1.0) AS relevance, diversity, exp(-0.693 * ((1706659200.0 - last_seen) / 86400.0) / 7) AS recency, consolidation, 0.0 AS richness FROM g WHERE frequency >= 2),
top AS (SELECT max(frequency) AS a, max(relevance) AS b, max(diversity) AS c, max(recency) AS d, max(consolidation) AS e FROM raw),
s AS (SELECT raw.*, 0.24 * (frequency / a) + 0.30 * (relevance / b) + 0.15 * (diversity / c) + 0.15 * (recency / CASE WHEN d > 0 THEN d ELSE 1.0 END) + 0.10 * (consolidation / e) + 0.06 * (richness / 1.0) AS score FROM raw, top)"""


def _ranked(spark, sf_dir):
    return ranking.rank_signals(ranking.signals_of_events(vault.events(spark, sf_dir), vault.EVENTS_NOW))


@query("six_signals", _SIGNALS + " SELECT path, floor(frequency * 1e6 + 0.5)::BIGINT AS frequency, floor(relevance * 1e6 + 0.5)::BIGINT AS relevance, floor(diversity * 1e6 + 0.5)::BIGINT AS diversity, floor(recency * 1e6 + 0.5)::BIGINT AS recency, floor(consolidation * 1e6 + 0.5)::BIGINT AS consolidation, floor(score * 1e6 + 0.5)::BIGINT AS score FROM s")
def six_signals(spark, sf_dir):
    return _ranked(spark, sf_dir).select("path", *(scores.micro(c).alias(c) for c in ("frequency", "relevance", "diversity", "recency", "consolidation", "score")))


@query("promote_maintain_prune", _SIGNALS + " SELECT CASE WHEN round_even(score, 3) >= 0.6 THEN 'promote' WHEN round_even(score, 3) >= 0.3 THEN 'maintain' ELSE 'prune' END AS verdict, count(*) AS n FROM s GROUP BY 1")
def promote_maintain_prune(spark, sf_dir):
    return _ranked(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


@query("recency_decay", "WITH " + vault.FILES + " SELECT path, floor(CASE WHEN mtime <= 0 THEN 0.0 ELSE exp(-ln(2) * greatest(0.0, (1721347200.0 - mtime) / 86400.0) / 14) END * 1e6 + 0.5)::BIGINT AS recency_micro FROM files")
def recency_decay(spark, sf_dir):
    return vault.files(spark, sf_dir).select("path", scores.micro(scores.half_life_decay("mtime", vault.NOW, 14)).alias("recency_micro"))


QUESTION = "then edinth is thndor thonndon ernd"
_NGRAMS = r"list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"


@query("budget_plan", "WITH " + vault.FILES + rf""",
h AS (SELECT path, mtime, substr(text, 1, 4000) AS head, trim(regexp_replace(lower(substr(text, 1, 4000)), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')) AS t FROM files),
q AS (SELECT {_NGRAMS.format("t")} AS g FROM (SELECT '{QUESTION}' AS t)),
n AS (SELECT path, mtime, head, CASE WHEN length(t) >= 3 THEN {_NGRAMS.format("t")} ELSE []::VARCHAR[] END AS g FROM h WHERE t <> ''),
j AS (SELECT path, mtime, head, len(list_intersect(n.g, q.g)) AS c, len(n.g) + len(q.g) - len(list_intersect(n.g, q.g)) AS u FROM n, q),
s AS (SELECT path, length(head) AS n, floor(coalesce(c / nullif(u, 0), 0.0) * 0.8 * (0.5 + 0.5 * exp(-ln(2) * greatest(0.0, (1721347200.0 - mtime) / 86400.0) / 14)) * 1e6 + 0.5)::BIGINT AS score_micro FROM j),
o AS (SELECT *, 15000 - coalesce(sum(n) OVER (ORDER BY score_micro DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s WHERE score_micro > 0)
SELECT path, score_micro, least(n, room)::BIGINT AS take FROM o WHERE room > 200""")
def budget_plan(spark, sf_dir):
    s = ranking.budget_scores(vault.files(spark, sf_dir), QUESTION, vault.NOW, vault.TODAY).withColumn("score_micro", scores.micro("score")).filter("score_micro > 0")
    order = [F.desc("score_micro"), "path"]
    s = ranking.head_rows(s.select("path", "score_micro", F.length("head").alias("n")), 15_000, order)
    return ranking.fill(s, 15_000, order, "n").select("path", "score_micro", "take")


@query("bootstrap_allocate", r"""
WITH f AS (SELECT source AS plan, doc_id AS ord, doc_id % 4 = 0 AS is_delta, n_chars AS chars, least(n_chars, 4000) AS want FROM documents),
r AS (SELECT *, sum(CASE WHEN is_delta THEN want ELSE 0 END) OVER (PARTITION BY plan) AS reserved, coalesce(sum(want) OVER (PARTITION BY plan, is_delta ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
s AS (SELECT *, CASE WHEN NOT is_delta THEN greatest(0, least(want, greatest(0, 15000 - reserved) - before)) END AS st FROM r),
d AS (SELECT *, coalesce(sum(st) OVER (PARTITION BY plan), 0) AS given FROM s),
t AS (SELECT *, CASE WHEN is_delta THEN greatest(0, least(want, 15000 - given - before)) ELSE st END AS take FROM d)
SELECT plan, ord, take::BIGINT AS take, CASE WHEN take = 0 AND chars > 0 THEN 'DROPPED' WHEN take < chars THEN 'truncated' ELSE 'full' END AS status FROM t""")
def bootstrap_allocate(spark, sf_dir):
    f = vault.table(spark, sf_dir, "documents").select(F.col("source").alias("plan"), F.col("doc_id").alias("ord"), (F.col("doc_id") % 4 == 0).alias("is_delta"), F.col("n_chars").alias("chars"))
    return ranking.allocate(f).select("plan", "ord", "take", "status")


@query("tail_budget_turns", "WITH s AS (SELECT conv_id, turn, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn FROM s WHERE total <= 1500 OR n = 1")
def tail_budget_turns(spark, sf_dir):
    return ranking.tail_budget(vault.messages(spark, sf_dir), 1500, ["conv_id"], "turn", F.length("text")).select("conv_id", "turn")


_M = "m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant'))"


def _records(spark, sf_dir):
    """Conversations as the messages that transcripts give: read back from JSON records."""
    m = vault.messages(spark, sf_dir).filter(F.col("role").isin("user", "assistant"))
    tool = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string>").alias("input"), F.lit(None).cast("string").alias("thinking")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Bash").alias("name"), F.struct(F.concat(F.lit("run "), F.col("turn").cast("string")).alias("command")).alias("input"), F.lit(None).cast("string").alias("thinking")),
        F.struct(F.lit("thinking").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string>").alias("input"), F.concat(F.lit("step "), F.col("turn").cast("string")).alias("thinking")),
    ).alias("content")).alias("message")))
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    return m.select("conv_id", "turn", F.try_parse_json(F.when(F.col("role") == "user", plain).otherwise(tool)).alias("record"))


def _messages(spark, sf_dir):
    return transcripts.messages(_records(spark, sf_dir), ("conv_id",), "turn")


@query("turn_counts", "WITH " + _M + r" SELECT conv_id, least(count(*) FILTER (WHERE role = 'user' AND regexp_matches(text, '\S')), 500) AS user_turns, least(count(*) FILTER (WHERE role = 'assistant'), 500) AS assistant_turns FROM m GROUP BY conv_id")
def turn_counts(spark, sf_dir):
    return transcripts.turn_counts(_messages(spark, sf_dir), ("conv_id",))


@query("turn_segments", "WITH " + _M + r" SELECT conv_id, turn, sum(CASE WHEN role = 'user' AND regexp_matches(text, '\S') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_no FROM m")
def turn_segments(spark, sf_dir):
    return transcripts.turns(_messages(spark, sf_dir), ("conv_id",), "turn").select("conv_id", "turn", "turn_no")


@query("last_user_turn", "WITH " + _M + r", l AS (SELECT conv_id, max(turn) AS last FROM m WHERE role = 'user' AND regexp_matches(text, '\S') GROUP BY conv_id) SELECT m.conv_id, turn, role FROM m JOIN l ON m.conv_id = l.conv_id AND turn >= last")
def last_user_turn(spark, sf_dir):
    return transcripts.last_turn(_messages(spark, sf_dir), ("conv_id",), "turn").select("conv_id", "turn", "role")


@query("actions_trace", "WITH " + _M + r" SELECT conv_id, turn, sha256(text) AS text_sha256, CASE WHEN role = 'assistant' THEN 'Bash(run ' || turn || ')' ELSE '' END AS actions, CASE WHEN role = 'assistant' THEN 'step ' || turn ELSE '' END AS thinking FROM m")
def actions_trace(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"), F.array_join("actions", " ").alias("actions"), transcripts.thinking_digest("thinking").alias("thinking"))


@query("capture_turns")
def capture_turns(spark, sf_dir):
    return transcripts.capture(_messages(spark, sf_dir), ("conv_id",), "turn").select("conv_id", "turn_no", F.length("prompt").alias("n_prompt"), F.length("head").alias("n_head"), F.size("actions").alias("n_actions"), "thinking")


_FOLD = r"""
WITH RECURSIVE {ev},
o AS (SELECT event_id, {key} AS key, at_s, row_number() OVER (PARTITION BY {key} ORDER BY at_s, event_id) AS n FROM ev),
w AS (SELECT event_id, key, n, at_s AS last, true AS yes FROM o WHERE n = 1
  UNION ALL SELECT o.event_id, o.key, o.n, CASE WHEN {no} THEN w.last ELSE o.at_s END, NOT ({no}) FROM w JOIN o ON o.key = w.key AND o.n = w.n + 1)
SELECT event_id, yes AS {out} FROM w"""


@query("dedup_window", _FOLD.format(ev=vault.EVENTS, key="user_id", no="o.at_s - w.last <= 43200.0", out="accepted"))
def dedup_window(spark, sf_dir):
    e = vault.events(spark, sf_dir).select("event_id", "user_id", "at")
    return state.dedup_window(e, "user_id", "at", 43200.0, ("event_id",)).select("event_id", "accepted")


@query("debounce", _FOLD.format(ev=vault.EVENTS, key="user_id", no="o.at_s - w.last < 86400.0", out="fired"))
def debounce(spark, sf_dir):
    e = vault.events(spark, sf_dir).select("event_id", "user_id", "at")
    return state.debounce(e, "user_id", "at", 1440, ("event_id",)).select("event_id", "fired")


def _streamed(spark, sf_dir, name, fold, columns):
    """Events as a stream, folded in event time; run over the whole table, in a folder that goes when the application ends."""
    folder = f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    at = f"{sf_dir}/events.parquet"
    # a stream of files takes a pattern, be the table one file or a folder
    e = spark.readStream.schema(spark.read.parquet(at).schema).parquet(f"{sf_dir}/event[s].parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value")).cast("int").alias("logged"), (F.col("event_type") == "view").alias("paused"))
    return event_time.run_available(event_time.folded(e, "user_id", "ts", fold, ("event_id",), delay="1 day"), folder).select("event_id", *columns)


# what the watermark has not passed (the last day, by its milliseconds) is still open
_CLOSED = vault.EVENTS.rstrip().removesuffix("FROM events)") + "FROM events WHERE epoch_us(ts) <= (SELECT epoch_ms(max(ts)) - 86400000 FROM events) * 1000)"


@query("dedup_event_time", _FOLD.format(ev=_CLOSED.lstrip(), key="user_id", no="o.at_s - w.last <= 43200.0", out="accepted"))
def dedup_event_time(spark, sf_dir):
    return _streamed(spark, sf_dir, "dedup-event-time", event_time.dedup(43200.0), ["accepted"])


@query("review_event_time", "WITH RECURSIVE " + _CLOSED.lstrip().replace("user_id, value", "user_id, floor(value) >= 10 AS enough, event_type = 'view' AS paused") + """,
o AS (SELECT event_id, user_id, enough, paused, row_number() OVER (PARTITION BY user_id ORDER BY at_s, event_id) AS n FROM ev),
w AS (SELECT event_id, user_id, n, 1 AS c, false AS fires, false AS notice, false AS told FROM o WHERE n = 1
  UNION ALL SELECT event_id, user_id, n, c, due AND NOT paused, due AND paused AND NOT told, told OR (due AND paused) FROM (
    SELECT o.event_id, o.user_id, o.n, o.paused, w.told, CASE WHEN w.fires THEN 1 ELSE w.c + 1 END AS c, CASE WHEN w.fires THEN 1 ELSE w.c + 1 END >= 15 AND o.enough AS due FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1))
SELECT event_id, fires, notice FROM w""")
def review_event_time(spark, sf_dir):
    return _streamed(spark, sf_dir, "review-event-time", event_time.review("logged", "paused"), ["fires", "notice"])


@query("journal_cadence", "WITH " + vault.EVENTS + ", n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY at_s, event_id) AS n FROM ev) SELECT event_id, ((n - 1) % 10 + 1)::INTEGER AS turn_count, n % 10 = 0 AS fires FROM n")
def journal_cadence(spark, sf_dir):
    return state.journal_cadence(vault.events(spark, sf_dir), "user_id", ["at", "event_id"]).select("event_id", F.col("turn_count").cast("int").alias("turn_count"), "fires")


@query("review_cadence", "WITH RECURSIVE " + vault.EVENTS.lstrip() + """,
o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY at_s, event_id) AS n FROM ev),
w AS (SELECT event_id, user_id, n, 1 AS c, false AS fires FROM o WHERE n = 1
  UNION ALL SELECT o.event_id, o.user_id, o.n, CASE WHEN w.fires THEN 1 ELSE w.c + 1 END, CASE WHEN w.fires THEN 1 ELSE w.c + 1 END >= 15 AND o.n // 2 >= 10 FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
SELECT event_id, fires FROM w""")
def review_cadence(spark, sf_dir):
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    e = vault.events(spark, sf_dir).withColumn("logged", F.floor(turn / 2).cast("int"))
    return state.review_cadence(e.select("event_id", "user_id", "at", "logged"), "user_id", "at", "logged").select("event_id", "fires")


@query("once_per_day", "WITH " + vault.EVENTS + ", n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM ev) SELECT event_id, user_id FROM n WHERE n = 1")
def once_per_day(spark, sf_dir):
    return state.once_per_day(vault.events(spark, sf_dir), "user_id", "ts", ("event_id",)).select("event_id", "user_id")


@query("ledger_backlog", r"""
WITH t AS (SELECT conv_id AS sid, sum(octet_length(encode(coalesce(text, ''))))::BIGINT * 40 AS size, 1721347200.0 - conv_id * 600.0 AS mtime, count(*) FILTER (WHERE role = 'assistant') AS n FROM conversations GROUP BY conv_id)
SELECT sid, size FROM t WHERE size >= 20000 AND mtime <= 1721347200.0 - 3600 AND sid % 7 <> 0""")
def ledger_backlog(spark, sf_dir):
    t = vault.messages(spark, sf_dir).groupBy(F.col("conv_id").alias("sid")).agg((F.sum(F.octet_length("text")) * 40).alias("size")).withColumn("mtime", F.lit(vault.NOW) - F.col("sid") * 600.0)
    ledger = t.filter("sid % 7 = 0").select("sid")
    return maintenance.backlog(t, ledger, vault.NOW).select("sid", "size")


@query("next_review", r"""
WITH t AS (SELECT conv_id AS sid, 1721347200.0 - (conv_id * 7919) % 1000 AS mtime, count(*) FILTER (WHERE role = 'assistant') AS n FROM conversations GROUP BY conv_id),
f AS (SELECT min((mtime, sid)) AS first FROM t WHERE n >= 4)
SELECT sid, CASE WHEN n >= 4 THEN 'next' ELSE 'skipped-thin' END AS status FROM t, f WHERE first IS NULL OR (mtime, sid) <= first""")
def next_review(spark, sf_dir):
    t = vault.messages(spark, sf_dir).groupBy(F.col("conv_id").alias("sid")).agg(F.count_if(F.col("role") == "assistant").alias("assistant_turns")).withColumn("mtime", F.lit(vault.NOW) - F.pmod(F.col("sid") * 7919, F.lit(1000)))
    return maintenance.next_review(t, 4)


@query("workspace_rollup", "WITH " + vault.FILES + " SELECT workspace, count(*) AS n_files, max(mtime) AS last_touched, sum(size)::BIGINT AS bytes FROM files GROUP BY workspace")
def workspace_rollup(spark, sf_dir):
    return reports.workspace_rollup(vault.files(spark, sf_dir))


def _commits(spark, sf_dir):
    """Orders as commits: the status gives the type, the customer the workspaces, the priority the topics."""
    o = vault.table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "add").when(F.col("o_orderstatus") == "O", "update").otherwise("wip")
    body = F.expr("concat('Workspace: ws', o_custkey % 9, ', ws', o_custkey % 4, '\n', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('Topics: t', o_orderkey % 6, ', t', o_orderkey % 8, '\n') END, 'Entries: +', o_custkey % 3, ' decision -', o_orderkey % 2, ' ref')")
    return gitlog.commits(o.select(F.sha1(F.col("o_orderkey").cast("string")).alias("hash"), F.concat(kind, F.lit("(ws): order "), F.col("o_orderkey").cast("string")).alias("subject"), body.alias("body")))


@query("changelog_rollup", r"""
WITH c AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'add' WHEN 'O' THEN 'update' ELSE 'other' END AS type, unnest(['ws' || (o_custkey % 9), 'ws' || (o_custkey % 4)]) AS workspace,
  CASE WHEN o_orderkey % 5 = 0 THEN []::VARCHAR[] ELSE ['t' || (o_orderkey % 6), 't' || (o_orderkey % 8)] END AS topics, o_custkey % 3 AS d, -(o_orderkey % 2) AS r FROM orders),
t AS (SELECT workspace, type, count(*) AS n FROM c GROUP BY 1, 2),
p AS (SELECT workspace, string_agg(topic, ' ' ORDER BY topic) AS topics FROM (SELECT DISTINCT workspace, unnest(topics) AS topic FROM c) GROUP BY 1),
e AS (SELECT workspace, sum(d) AS d, sum(r) AS r FROM c GROUP BY 1)
SELECT t.workspace, sum(n)::BIGINT AS commits, string_agg(type || '=' || n, ' ' ORDER BY type) AS types, any_value(topics) AS topics, coalesce(nullif(any_value(e.d), 0), 0)::BIGINT AS decision, coalesce(nullif(any_value(e.r), 0), 0)::BIGINT AS ref FROM t LEFT JOIN p USING (workspace) LEFT JOIN e USING (workspace) GROUP BY t.workspace""")
def changelog_rollup(spark, sf_dir):
    c = reports.changelog(_commits(spark, sf_dir))
    types = F.array_join(F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    sums = lambda k: F.coalesce(F.try_element_at("entries", F.lit(k)), F.lit(0)).cast("long").alias(k)
    return c.select("workspace", "commits", types.alias("types"), F.array_join("topics", " ").alias("topics"), sums("decision"), sums("ref"))


@query("commit_types", "SELECT CASE o_orderstatus WHEN 'F' THEN 'add' WHEN 'O' THEN 'update' ELSE 'other' END AS type, count(*) AS n FROM orders GROUP BY 1")
def commit_types(spark, sf_dir):
    return reports.type_totals(_commits(spark, sf_dir))


_HANDOFF = "'# Handoff' || chr(10) || '## 2024-07-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || ' a' || chr(10) || '- host1: [done] 2024-06-0' || (doc_id % 9 + 1) || ' x' || chr(10) || '  more' || chr(10) || '- host2: [doing] 2024-05-01 y' || chr(10) || '## 2024-06-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'b c' || chr(10) || 'text' || chr(10) || '## notes' || chr(10) || 'z'"


@query("handoff_rotate", r"""
WITH s AS (SELECT doc_id, unnest([0, 1, 2, 3])::INTEGER AS i FROM documents)
SELECT doc_id, i, i = 2 AS archived, CASE WHEN i = 1 THEN 1 ELSE 0 END AS n_stale FROM s""")
def handoff_rotate(spark, sf_dir):
    spark_text = _HANDOFF.replace("chr(10)", "'\\n'").replace("::VARCHAR", "").replace("(doc_id % 28 + 1)", "cast(doc_id % 28 + 1 AS string)")
    h = vault.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.expr(spark_text).alias("text"))
    done = maintenance.rotate_handoff(h, vault.TODAY, keep=1)
    return done.select(F.col("path").alias("doc_id"), "i", "archived", F.size("stale").alias("n_stale"))


@query("research_gate", r"""
WITH n AS (SELECT source AS topic, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Source: x' || chr(10) ELSE '' END || coalesce(text, '') AS text FROM documents),
g AS (SELECT topic, count(*) AS raw_count, count(*) FILTER (WHERE NOT (regexp_matches(text, '(?m)^(source_file|source_files|repo|clone_path):') OR regexp_matches(text, '(?m)^Source:') OR regexp_matches(text, '[\w./-]+\.\w+:\d+'))) AS missing FROM n GROUP BY topic),
d AS (SELECT source AS topic, len(list_filter(regexp_split_to_array(trim(regexp_replace(coalesce(arg_min(text, doc_id), ''), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS words FROM documents GROUP BY source)
SELECT topic, raw_count, missing, words::INTEGER AS words, missing = 0 AND words < 800 AS passed FROM g JOIN d USING (topic)""")
def research_gate(spark, sf_dir):
    d = vault.table(spark, sf_dir, "documents")
    notes = d.select(F.col("source").alias("topic"), F.concat(F.lit("n/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.when(F.col("doc_id") % 3 == 0, "Source: x\n").otherwise(""), F.coalesce("text", F.lit(""))).alias("text"))
    done = d.groupBy(F.col("source").alias("topic")).agg(F.coalesce(F.min_by("text", "doc_id"), F.lit("")).alias("text"))
    return maintenance.research_status(notes, done).select("topic", "raw_count", F.size("missing_refs").cast("long").alias("missing"), F.col("distilled_words").alias("words"), "passed")


@query("topic_index", "WITH " + vault.FILES + r""" SELECT workspace, topic, count(*) AS n_aspects, list_last(string_split(max((aspect_date, path))[2], '/')) AS newest FROM files GROUP BY 1, 2""")
def topic_index(spark, sf_dir):
    t = reports.topic_index(vault.files(spark, sf_dir))
    return t.select("workspace", "topic", "n_aspects", F.regexp_extract("listing", r"^- ([^:]+):", 1).alias("newest"))


@query("score_trend", "WITH e AS (SELECT event_id, user_id, value, lag(value) OVER w AS a, lag(value, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, CASE WHEN value < a AND a < b THEN 'declining' WHEN value <= 2 AND a <= 2 AND b <= 2 THEN 'stuck' ELSE 'steady' END AS trend FROM e")
def score_trend(spark, sf_dir):
    return reports.score_trend(vault.table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", "trend")


@query("ext_event_windows", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def ext_event_windows(spark, sf_dir):
    e = vault.table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


