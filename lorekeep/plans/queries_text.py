"""Queries of recall, chunks, texts, the gate and redaction."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..functions import gate, privacy, scores, text
from ..operators import index, joins, lines, recall, tags
from ..session import delete_at_exit, shared_folder
from . import vault

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


ASKED = "worthless clown idiot pathetic mail7.example.com token"
PHRASES = recall.match_terms(recall.Profile("", ("worthless", "clown", "idiot", "pathetic", "mail7.example.com", "token"), "", False, None))
_MARKED, _PLAIN = text.fold_table()
_WEIGHTS = list(index.WEIGHTS.items())


def _count(col: str, phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({col}, lambda t: t = '{phrase[0]}'))"
    hit = " AND ".join(f"{col}[i + {j}] = '{p}'" for j, p in enumerate(phrase))
    return f"len(list_filter(range(1, greatest(len({col}) - {len(phrase) - 2}, 1)), lambda i: {hit}))"


def _tokens(col: str) -> str:
    return f"regexp_extract_all(translate(lower({col}), '{_MARKED}', '{_PLAIN}'), '[\\pL\\pN]+')"


#: chunk rows with score_micro, statistics over all chunks
RANKED = (
    "WITH "
    + vault.CHUNKS
    + f""",
toks AS (SELECT *, {', '.join(f"{_tokens(c)} AS t_{c}" for c, _ in _WEIGHTS)} FROM chunks),
counted AS (SELECT *, {' + '.join(f'len(t_{c})' for c, _ in _WEIGHTS)} AS n_tokens, {', '.join(f"{' + '.join(f'{w} * {_count(f"t_{c}", p)}' for c, w in _WEIGHTS)} AS f_{i}" for i, p in enumerate(PHRASES))} FROM toks),
stats AS (SELECT count(*) AS N, sum(n_tokens) / count(*) AS avgdl, {', '.join(f'count(*) FILTER (WHERE f_{i} > 0) AS n_{i}' for i in range(len(PHRASES)))} FROM counted),
scored AS (SELECT chunks_.*, -(0.0 {''.join(f" + CASE WHEN ln((N - n_{i} + 0.5) / (n_{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - n_{i} + 0.5) / (n_{i} + 0.5)) END * (f_{i} * 2.2 / (f_{i} + 1.2 * (0.25 + 0.75 * n_tokens / avgdl)))" for i in range(len(PHRASES)))}) AS score
  FROM counted chunks_, stats WHERE {' OR '.join(f'f_{i} > 0' for i in range(len(PHRASES)))}),
micro AS (SELECT *, floor(score * 1e6 + 0.5)::BIGINT AS score_micro FROM scored)"""
)


def _ranked(spark, sf_dir):
    return recall.bm25(vault.chunks(spark, sf_dir), PHRASES).withColumn("score_micro", scores.micro("score"))


_OUT = ("path", "ci", "tag", "keywords", "score_micro")


@query("recall_bm25_topk", RANKED + ", best AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score_micro, chunk_id) AS n FROM micro) SELECT path, ci, tag, keywords, score_micro FROM best WHERE n = 1 ORDER BY score_micro, chunk_id LIMIT 20")
def recall_bm25_topk(spark, sf_dir):
    return recall.collapse(_ranked(spark, sf_dir), "score_micro", "chunk_id").orderBy("score_micro", "chunk_id").limit(20).select(*_OUT)


@query("recall_tag_filter", RANKED + ", best AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score_micro, chunk_id) AS n FROM micro WHERE tag = 'ref' AND path ILIKE 'workspaces/src%' AND keywords ILIKE '%src1%' AND path ILIKE '%/en/%' AND mtime >= 1721347200 - 180 * 86400) SELECT path, ci, tag, keywords, score_micro FROM best WHERE n = 1 ORDER BY score_micro, chunk_id LIMIT 20")
def recall_tag_filter(spark, sf_dir):
    keep = recall.filters(tag="ref", keyword="src1", topic="en", days=180, now=vault.NOW) & F.lower("path").like("workspaces/src%")
    return recall.collapse(_ranked(spark, sf_dir).filter(keep), "score_micro", "chunk_id").orderBy("score_micro", "chunk_id").limit(20).select(*_OUT)


@query("recall_collapse_off", RANKED + " SELECT path, ci, tag, keywords, score_micro FROM micro ORDER BY score_micro, chunk_id LIMIT 50")
def recall_collapse_off(spark, sf_dir):
    return _ranked(spark, sf_dir).orderBy("score_micro", "chunk_id").limit(50).select(*_OUT)


@query("recall_recent_empty_query", "WITH " + vault.CHUNKS + ", best AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC, chunk_id DESC) AS n FROM chunks) SELECT path, ci, tag FROM best WHERE n = 1 ORDER BY mtime DESC, chunk_id DESC LIMIT 25")
def recall_recent_empty_query(spark, sf_dir):
    return recall.recall(vault.chunks(spark, sf_dir), "", 25).select("path", "ci", "tag")


@query("recall_indexed_topk", RANKED + " SELECT chunk_id, score_micro FROM micro ORDER BY score_micro, chunk_id LIMIT 50")
def recall_indexed_topk(spark, sf_dir):
    """From an index stored below the shared folder: only the buckets of the query's terms are read."""
    found = recall.bm25_stored(stored_index(spark, sf_dir), PHRASES)
    return found.select(_shown().alias("chunk_id"), scores.micro("score").alias("score_micro")).orderBy("score_micro", "chunk_id").limit(50)


_stored: dict[tuple[str, str], str] = {}


def stored_index(spark, sf_dir: str) -> index.StoredIndex:
    """The index of the chunks, written once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = f"{shared_folder(spark)}/index-{key[0]}-{zlib.crc32(sf_dir.encode()):08x}"
        delete_at_exit(spark, path)
        # a text of over 1,000 chunks runs into the chunk_id of the next document, so the index has an id of its own
        index.write_index(vault.chunks(spark, sf_dir).withColumn("chunk_id", F.shiftleft("doc_id", 24) + F.col("ci")), path, 32)
        _stored[key] = path
    return index.open_index(spark, _stored[key])


def _shown():
    """The chunk_id of ``vault.chunks``."""
    return F.shiftright("chunk_id", 24) * 1000 + F.col("chunk_id").bitwiseAND(F.lit((1 << 24) - 1))


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(tags.stopwords())) + "]"


@query(
    "recall_batch_topk",
    "WITH "
    + vault.CHUNKS
    + f""",
toks AS (SELECT chunk_id, {', '.join(f"{_tokens(c)} AS t_{c}" for c, _ in _WEIGHTS)} FROM chunks),
lengths AS (SELECT *, {' + '.join(f'len(t_{c})' for c, _ in _WEIGHTS)} AS n_tokens FROM toks),
stats AS (SELECT count(*) AS N, sum(n_tokens) / count(*) AS avgdl FROM lengths),
postings AS (SELECT chunk_id, n_tokens, term, sum(w) AS f FROM ({' UNION ALL '.join(f"SELECT chunk_id, n_tokens, unnest(t_{c}) AS term, {w} AS w FROM lengths" for c, w in _WEIGHTS)}) GROUP BY ALL),
holding AS (SELECT term, count(*) AS held FROM postings GROUP BY term),
prose AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({_STOP}, w)) AS w FROM benchmark),
asked AS (SELECT item_id, translate(unnest(list_filter(w, lambda x, i: list_position(w, x) = i)[1:12]), '{_MARKED}', '{_PLAIN}') AS term FROM prose),
scored AS (SELECT item_id, chunk_id, -sum(CASE WHEN ln((N - held + 0.5) / (held + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - held + 0.5) / (held + 0.5)) END * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / avgdl)))) AS score
  FROM asked JOIN holding USING (term) JOIN postings USING (term), stats GROUP BY item_id, chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, chunk_id) AS rank FROM scored)
SELECT item_id, rank::INTEGER AS rank, floor(score * 1e6 + 0.5)::BIGINT AS score_micro FROM ranked WHERE rank <= 10""",
)
def recall_batch_topk(spark, sf_dir):
    """All items of the benchmark as queries, ten chunks each, in one plan; equal scores make the chunks themselves a matter of order, so ranks and scores are shown."""
    plain = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "))
    queries = vault.table(spark, sf_dir, "benchmark").select("item_id", recall.query_phrases(plain).alias("phrases"))
    found = recall.bm25_batch(stored_index(spark, sf_dir), queries, 10)
    return found.select("item_id", "rank", scores.micro("score").alias("score_micro"))


@query("query_answer_type", "SELECT item_id, CASE " + " ".join("WHEN regexp_matches(text, '(?i)\\b(" + cue.replace("'", "''") + f")\\b') THEN '{kind}'" for kind, cue in recall.TYPE_CUES) + " ELSE '' END AS answer_type FROM benchmark")
def query_answer_type(spark, sf_dir):
    return vault.table(spark, sf_dir, "benchmark").select("item_id", recall.answer_type("text").alias("answer_type"))


_STRIP = r"array_to_string(list_transform(string_split(content, chr(10)), lambda l: regexp_replace(l, '\s*#[A-Za-z0-9_][A-Za-z0-9._-]*(?:\s+#[A-Za-z0-9_][A-Za-z0-9._-]*)*\s*$', '')), chr(10))"


@query("chunk_split_1500", "WITH " + vault.CHUNKS + f" SELECT doc_id, ci, length(content)::INTEGER AS n_chars, substr(sha1({_STRIP}), 1, 16) AS hash FROM chunks")
def chunk_split_1500(spark, sf_dir):
    return vault.chunks(spark, sf_dir).select("doc_id", "ci", F.length("content").alias("n_chars"), text.chunk_hash("content").alias("hash"))


@query("chunk_hash_dedup", "WITH " + vault.CHUNKS + f", h AS (SELECT chunk_id, tag, substr(sha1({_STRIP}), 1, 16) AS hash FROM chunks) SELECT tag, hash, min(chunk_id) AS chunk_id, count(*) AS copies FROM h GROUP BY tag, hash HAVING count(*) > 1")
def chunk_hash_dedup(spark, sf_dir):
    c = vault.chunks(spark, sf_dir).select("chunk_id", "tag", text.chunk_hash("content").alias("hash"))
    return c.groupBy("tag", "hash").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("copies")).filter("copies > 1")


@query("cross_file_dup", "WITH " + vault.CHUNKS + f", h AS (SELECT doc_id, chunk_id, content, substr(sha1({_STRIP}), 1, 16) AS hash FROM chunks), n AS (SELECT doc_id, hash FROM h) SELECT h.chunk_id, h.hash, EXISTS (SELECT 1 FROM n WHERE n.hash = h.hash AND n.doc_id < h.doc_id) AS is_duplicate FROM h")
def cross_file_dup(spark, sf_dir):
    h = vault.chunks(spark, sf_dir).select("doc_id", "chunk_id", text.chunk_hash("content").alias("hash"))
    first = h.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return h.join(first, "hash").select("chunk_id", "hash", (F.col("first") < F.col("doc_id")).alias("is_duplicate"))


def _redacted(col: str) -> str:
    """SQL of the redacted text and the number of redactions, one step a pattern."""
    steps, last = [], "base"
    for i, (label, pattern) in enumerate(privacy.PATTERNS):
        p = pattern.replace("'", "''")
        steps.append(f"r{i} AS (SELECT id, n + len(regexp_extract_all(t, '{p}')) AS n, regexp_replace(t, '{p}', '[REDACTED:{label}]', 'g') AS t FROM {last})")
        last = f"r{i}"
    return f"WITH base AS (SELECT doc_id AS id, 0 AS n, coalesce({col}, '') AS t FROM documents), " + ", ".join(steps) + f", done AS (SELECT * FROM {last})"


@query("sanitize_redact", _redacted("text") + " SELECT id AS doc_id, n::INTEGER AS redactions, sha256(t) AS text_sha256 FROM done")
def sanitize_redact(spark, sf_dir):
    d = vault.table(spark, sf_dir, "documents").select("doc_id", privacy.sanitize("text").alias("s"))
    return d.select("doc_id", F.col("s.n").alias("redactions"), F.sha2("s.text", 256).alias("text_sha256"))


@query("redaction_counts", _redacted("text") + " SELECT source, count(*) AS docs, sum(n)::BIGINT AS redactions, count(*) FILTER (WHERE n > 0) AS redacted_docs FROM done JOIN documents ON id = doc_id GROUP BY source")
def redaction_counts(spark, sf_dir):
    d = vault.table(spark, sf_dir, "documents").select("source", privacy.sanitize("text")["n"].alias("n"))
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("redactions"), F.count_if(F.col("n") > 0).alias("redacted_docs"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_L = r"[^\p{L}\p{N}_]"
_HEDGES = gate.HEDGE.replace(" ", "[ ]{2}")
GATE = "WITH " + vault.ENTRIES + rf""",
parts AS (SELECT doc_id, workspace, line, text AS raw, lower(regexp_extract(text, {_sql(gate.TAG_PREFIX)}, 1)) AS tag,
  regexp_replace(regexp_replace(text, {_sql(gate.TAG_PREFIX)}, ''), '^\s+|\s+$', '', 'g') AS body FROM entries),
m AS (SELECT *, regexp_matches(raw, {_sql(gate.EVIDENCE)}) AS evident,
  len(regexp_extract_all(' ' || regexp_replace(body, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' ', {_sql(f'(?i){_L}(?:{_HEDGES}){_L}')})) AS hits,
  len(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+')) AS words FROM parts),
gated AS (SELECT doc_id, workspace, line, tag, hits, words, CASE
  WHEN trim(raw) = '' THEN 'empty'
  WHEN {' OR '.join(f'regexp_matches(raw, {_sql(p)})' for p in gate.SECRETS)} THEN 'secret_leak'
  WHEN regexp_matches(body, {_sql(gate.PLACEHOLDER)}) THEN 'placeholder'
  WHEN length(body) < 20 THEN 'too_short'
  WHEN hits > 0 AND NOT evident AND tag <> 'hypothesis' AND (hits / greatest(words, 1) > 0.25 OR words < 12) THEN 'hedged_no_evidence'
  WHEN tag = 'ref' AND NOT (regexp_matches(raw, '(?i)source:') OR regexp_matches(raw, 'https?://') OR regexp_matches(raw, {_sql(gate.whole('verified|verify path|xác minh|kiểm chứng'))}) OR evident) THEN 'ref_without_source'
  WHEN tag = 'decision' AND NOT (regexp_matches(raw, {_sql(gate.whole(gate.RATIONALE))}) OR regexp_matches(raw, {_sql(gate.whole(gate.TRADEOFF))}) OR contains(raw, '→')) THEN 'decision_without_rationale'
  WHEN tag = 'tool' AND NOT (regexp_matches(raw, {_sql(gate.VERSION)}) OR regexp_matches(raw, {_sql(gate.COMMAND)})) THEN 'tool_without_version_or_syntax'
  WHEN tag = 'hypothesis' AND NOT regexp_matches(raw, {_sql(gate.whole(gate.VERIFY))}) THEN 'hypothesis_without_verify'
  WHEN tag = 'goal' AND NOT (regexp_matches(raw, {_sql(gate.whole(gate.GOAL_STATUS))}) OR regexp_matches(raw, '(?i)status:\s*\S')) THEN 'goal_without_status'
  END AS reason FROM m)"""


@query("gate_reasons", GATE + " SELECT doc_id, line, tag, reason FROM gated")
def gate_reasons(spark, sf_dir):
    return vault.entries(spark, sf_dir).select("doc_id", "line", gate.tag_of("text").alias("tag"), gate.reason("text").alias("reason"))


@query("gate_histogram", GATE + " SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM gated GROUP BY 1")
def gate_histogram(spark, sf_dir):
    return vault.entries(spark, sf_dir).select(F.coalesce(gate.reason("text"), F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("hedge_ratio", GATE + " SELECT doc_id, sum(hits)::BIGINT AS hits, sum(words)::BIGINT AS words, floor(sum(hits) / greatest(sum(words), 1) * 1e6 + 0.5)::BIGINT AS ratio_micro FROM gated GROUP BY doc_id")
def hedge_ratio(spark, sf_dir):
    b = vault.entries(spark, sf_dir).select("doc_id", gate.body_of("text").alias("b"))
    g = b.groupBy("doc_id").agg(F.sum(gate.hedge_hits("b")).alias("hits"), F.sum(gate.word_total("b")).alias("words"))
    return g.withColumn("ratio_micro", scores.micro(F.col("hits") / F.greatest("words", F.lit(1))))


@query("compress_runs", "WITH " + vault.FILES + r""",
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1))::INTEGER AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM files WHERE text <> '')),
s AS (SELECT *, CASE WHEN lag(line) OVER (PARTITION BY doc_id ORDER BY i) IS NOT DISTINCT FROM line AND i > 1 THEN 0 ELSE 1 END AS starts FROM l),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s)
SELECT doc_id, min(i)::INTEGER AS line, count(*)::INTEGER AS n, sha256(any_value(line)) AS line_sha256 FROM g WHERE trim(line) <> '' GROUP BY doc_id, run HAVING count(*) >= 3""")
def compress_runs(spark, sf_dir):
    runs = lines.repeat_runs(vault.files(spark, sf_dir), ["doc_id"])
    return runs.select("doc_id", "line", "n", F.sha2("content", 256).alias("line_sha256"))


@query("compress_text", "WITH " + vault.FILES + r""",
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1))::INTEGER AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM files WHERE text <> '')),
s AS (SELECT *, CASE WHEN lag(line) OVER (PARTITION BY doc_id ORDER BY i) IS NOT DISTINCT FROM line AND i > 1 THEN 0 ELSE 1 END AS starts FROM l),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
r AS (SELECT doc_id, run, count(*) AS n, any_value(line) AS line FROM g GROUP BY doc_id, run),
o AS (SELECT doc_id, string_agg(CASE WHEN n >= 3 AND trim(line) <> '' THEN line || '  (×' || n || ')' ELSE array_to_string(list_transform(range(0, n), lambda k: line), chr(10)) END, chr(10) ORDER BY run) AS t FROM r GROUP BY doc_id)
SELECT f.doc_id, sha256(coalesce(o.t, '') || CASE WHEN suffix(f.text, chr(10)) THEN chr(10) ELSE '' END) AS text_sha256 FROM files f LEFT JOIN o USING (doc_id)""")
def compress_text(spark, sf_dir):
    return vault.files(spark, sf_dir).select("doc_id", F.sha2(lines.collapse_repeats("text"), 256).alias("text_sha256"))


@query("group_prefix", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') AS ws FROM documents),
n AS (SELECT doc_id, unnest(range(0, len(ws)))::INTEGER AS i, unnest(ws) AS v FROM w),
g AS (SELECT doc_id, i // 7 AS k, min(i) AS lo, count(*) AS n, list(v ORDER BY i) AS vs FROM n GROUP BY doc_id, i // 7),
o AS (SELECT doc_id, string_agg(CASE WHEN n >= 5 THEN 'key' || k || ': [' || n || ' items: ' || array_to_string(vs[1:5], ', ') || CASE WHEN n > 5 THEN ', +' || (n - 5) || ' more' ELSE '' END || ']'
  ELSE array_to_string(list_transform(vs, lambda v: 'key' || k || ': ' || v), chr(10)) END, chr(10) ORDER BY k) AS t FROM g GROUP BY doc_id)
SELECT w.doc_id, sha256(coalesce(t, '')) AS text_sha256 FROM w LEFT JOIN o USING (doc_id)""")
def group_prefix(spark, sf_dir):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), 0)
    keyed = F.transform(words, lambda v, i: F.concat(F.lit("key"), F.floor(i / 7).cast("string"), F.lit(": "), v))
    d = vault.table(spark, sf_dir, "documents").select("doc_id", F.array_join(keyed, "\n").alias("t"))
    return d.select("doc_id", F.sha2(lines.group_by_prefix("t"), 256).alias("text_sha256"))


FUZZY = "then edinth is thndor, thonndon ernd reer thor edtionnt to, nd sting antilyou erer"
_NORM = r"trim(regexp_replace(lower({0}), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


@query("trigram_fuzzy_topk", rf"""
WITH q AS (SELECT list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS g FROM (SELECT {_NORM.format("'" + FUZZY + "'")} AS t)),
d AS (SELECT doc_id, CASE WHEN length(t) >= 3 THEN list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) ELSE []::VARCHAR[] END AS g FROM (SELECT doc_id, {_NORM.format("coalesce(text, '')")} AS t FROM documents)),
s AS (SELECT doc_id, len(list_intersect(d.g, q.g)) AS c, len(d.g) AS nd, len(q.g) AS nq FROM d, q)
SELECT doc_id, floor(coalesce(c / nullif(nd + nq - c, 0), 0) * 1e6 + 0.5)::BIGINT AS score_micro FROM s WHERE coalesce(c / nullif(nd + nq - c, 0), 0) >= 0.15 ORDER BY score_micro DESC, doc_id LIMIT 10""")
def trigram_fuzzy_topk(spark, sf_dir):
    d = vault.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return recall.fuzzy(d, FUZZY).select("doc_id", scores.micro("score").alias("score_micro"))


_GRAMS = "CASE WHEN length(t) >= 3 THEN list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) ELSE []::VARCHAR[] END"


@query("fuzzy_join_topk", rf"""
WITH q AS (SELECT item_id, {_GRAMS} AS g FROM (SELECT item_id, {_NORM.format("coalesce(text, '')")} AS t FROM benchmark)),
d AS (SELECT doc_id, {_GRAMS} AS g FROM (SELECT doc_id, {_NORM.format("coalesce(text, '')")} AS t FROM documents)),
s AS (SELECT item_id, doc_id, len(list_intersect(d.g, q.g)) AS c, len(d.g) AS nd, len(q.g) AS nq FROM d, q),
r AS (SELECT item_id, doc_id, coalesce(c / nullif(nd + nq - c, 0), 0) AS score FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score >= 0.15)
SELECT item_id, doc_id, rank::INTEGER AS rank, floor(score * 1e6 + 0.5)::BIGINT AS score_micro FROM n WHERE rank <= 3""")
def fuzzy_join_topk(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    q = vault.table(spark, sf_dir, "benchmark").select("item_id", t.alias("q"))
    d = vault.table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))
    return recall.fuzzy_join(q, d).select("item_id", "doc_id", "rank", scores.micro("score").alias("score_micro"))


@query("char_ngram_counts", rf"""
SELECT doc_id, (CASE WHEN length(t) >= 3 THEN len(list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) ELSE 0 END)::INTEGER AS n_grams FROM (SELECT doc_id, {_NORM.format("coalesce(text, '')")} AS t FROM documents)""")
def char_ngram_counts(spark, sf_dir):
    return vault.table(spark, sf_dir, "documents").select("doc_id", F.size(text.char_ngrams(F.coalesce("text", F.lit("")))).alias("n_grams"))


@query("word_set_sizes", r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{4,}')))::INTEGER AS words4, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{5,}')))::INTEGER AS words5 FROM documents")
def word_set_sizes(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return vault.table(spark, sf_dir, "documents").select("doc_id", F.size(text.word_set(t, 4)).alias("words4"), F.size(text.word_set(t, 5)).alias("words5"))


@query("digests", rf"SELECT doc_id, sha256(lang || chr(0) || {_NORM.format("coalesce(text, '')")}) AS digest, sha1(lower(trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')))) AS salvage_hash, (length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents")
def digests(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return vault.table(spark, sf_dir, "documents").select("doc_id", text.digest("lang", t).alias("digest"), text.salvage_hash(t).alias("salvage_hash"), text.token_estimate(t).alias("tokens"))


@query("polarity_signature", "WITH " + vault.ENTRIES + ", t AS (SELECT doc_id, line, lower(text) AS t FROM entries), s AS (SELECT doc_id, line, regexp_matches(t, '(?:^|[^\\p{L}\\p{N}_''])(?:" + "|".join(joins.NEGATIONS).replace("'", "''") + ")(?:$|[^\\p{L}\\p{N}_''])') AS neg, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{w})(?:$|[^\\p{{L}}\\p{{N}}_])') THEN '{w}' END" for w in dict.fromkeys(w for p in joins.POLARITY for w in p)) + "], lambda x: x IS NOT NULL) AS terms FROM t) SELECT doc_id, line, array_to_string(list_sort(list_transform(terms, lambda w: w || CASE WHEN neg THEN ':neg' ELSE '' END)), ' ') AS signature FROM s WHERE len(terms) > 0")
def polarity_signature(spark, sf_dir):
    e = vault.entries(spark, sf_dir).select("doc_id", "line", joins.polarity("text").alias("p")).filter(F.size("p.terms") > 0)
    return e.select("doc_id", "line", F.array_join(joins.signature(F.col("p")), " ").alias("signature"))


@query("extract_tags")
def extract_tags(spark, sf_dir):
    from ..operators import tags

    return vault.entries(spark, sf_dir).select("doc_id", "line", F.array_join(tags.extract_tags("text"), " ").alias("tags"))


@query("ext_cosine_topk", """
WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (
SELECT vec_id, list_reduce(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: z[1] * z[2]), lambda x, y: x + y, 0.0) / (sqrt(list_reduce(list_transform(embedding::DOUBLE[], lambda x: x * x), lambda x, y: x + y, 0.0)) * sqrt(list_reduce(list_transform(q, lambda x: x * x), lambda x, y: x + y, 0.0))) AS score FROM embeddings, q)
SELECT vec_id, floor(score * 1e6 + 0.5)::BIGINT AS score_micro FROM s ORDER BY score DESC, vec_id LIMIT 10""")
def ext_cosine_topk(spark, sf_dir):
    e = vault.table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").first()["embedding"]
    return recall.cosine_topk(e, [float(x) for x in q]).select("vec_id", scores.micro("score").alias("score_micro"))
