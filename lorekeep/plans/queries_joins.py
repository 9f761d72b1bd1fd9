"""Queries of joins between entries and files: near copies, contradictions, routing, links, deduplication, upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, paths, scores, text
from ..operators import index, joins, lines, maintenance
from ..sources import vault as source
from . import vault

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_WORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{4,}'))"


def _pairs(low: float, high: float) -> str:
    """SQL of the pairs of files of a workspace by Jaccard of their word sets, over all common words."""
    return (
        "WITH " + vault.FILES + f""",
s AS (SELECT doc_id, workspace, {_WORDS} AS ws FROM files),
w AS (SELECT doc_id, workspace, len(ws) AS n, unnest(ws) AS w FROM s),
p AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM w a JOIN w b ON a.workspace = b.workspace AND a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2),
j AS (SELECT id_a, id_b, c / (na + nb - c) AS similarity FROM p)
SELECT id_a, id_b, floor(similarity * 1e6 + 0.5)::BIGINT AS similarity_micro FROM j WHERE similarity >= {low} AND similarity <= {high}"""
    )


def _first_free(nodes: str, edges: str) -> str:
    """SQL of ``seeds`` (g, s): the ids that no earlier seed of their group is linked to, found one after the other."""
    return f"""
steps AS (SELECT g, [min(o)] AS seeds FROM {nodes} GROUP BY g UNION ALL
  SELECT g, list_append(seeds, nxt) FROM (SELECT t.g, t.seeds, (SELECT min(n.o) FROM {nodes} n WHERE n.g = t.g AND n.o > t.seeds[-1] AND NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.g = t.g AND e.b = n.o AND list_contains(t.seeds, e.a))) AS nxt FROM steps t) WHERE nxt IS NOT NULL),
seeds AS (SELECT g, unnest(arg_max(seeds, len(seeds))) AS s FROM steps GROUP BY g)"""


@query("token_jaccard_pairs", _pairs(0.85, 1.0))
def token_jaccard_pairs(spark, sf_dir):
    p = joins.similar_pairs(vault.files(spark, sf_dir), 0.85, 1.0, "doc_id", within="workspace")
    return p.select("id_a", "id_b", scores.micro("similarity").alias("similarity_micro"))


@query("lint_band_pairs", _pairs(0.4, 0.85) + " AND 1.0 - similarity >= 0.15")
def lint_band_pairs(spark, sf_dir):
    p = joins.lint_pairs(vault.files(spark, sf_dir), "doc_id", within="workspace")
    return p.select("id_a", "id_b", scores.micro("similarity").alias("similarity_micro"))


_TERMS = list(dict.fromkeys(w for p in joins.POLARITY for w in p))
_STOP = ", ".join(f"'{w}'" for w in joins.STOPWORDS)
_OPPOSITE = " OR ".join(f"(list_contains(a.terms, '{x}') AND list_contains(b.terms, '{y}')) OR (list_contains(a.terms, '{y}') AND list_contains(b.terms, '{x}'))" for x, y in joins.POLARITY)


@query("contradiction_pairs", "WITH " + vault.ENTRIES + rf""",
k AS (SELECT doc_id, workspace, line, lower(text) AS t, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{4,}}')), lambda w: NOT list_contains([{_STOP}], w)) AS kw FROM entries WHERE regexp_matches(text, '\[(ref|decision|tool|hypothesis)\]')),
s AS (SELECT doc_id, workspace, line, kw, regexp_matches(t, '(?:^|[^\p{{L}}\p{{N}}_''])(?:{"|".join(joins.NEGATIONS).replace("'", "''")})(?:$|[^\p{{L}}\p{{N}}_''])') AS neg,
  list_filter([{", ".join(f"CASE WHEN regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{w})(?:$|[^\\p{{L}}\\p{{N}}_])') THEN '{w}' END" for w in _TERMS)}], lambda x: x IS NOT NULL) AS terms FROM k),
c AS (SELECT * FROM s WHERE len(terms) > 0),
p AS (SELECT a.doc_id AS doc_a, a.line AS line_a, b.doc_id AS doc_b, b.line AS line_b, len(list_intersect(a.kw, b.kw)) AS n_shared FROM c a JOIN c b ON a.workspace = b.workspace AND (a.doc_id, a.line) < (b.doc_id, b.line)
  AND ((NOT a.neg AND NOT b.neg AND ({_OPPOSITE})) OR (a.neg <> b.neg AND list_has_any(a.terms, b.terms))))
SELECT doc_a, line_a, doc_b, line_b, n_shared::INTEGER AS n_shared FROM p WHERE n_shared >= 3""")
def contradiction_pairs(spark, sf_dir):
    rows = vault.entries(spark, sf_dir).filter(F.col("text").rlike(joins.CLAIM)).select("workspace", F.col("doc_id").alias("path"), "line", "text")
    found = joins.opposed_pairs(rows, within="workspace")
    return found.select(F.col("id_a.path").alias("doc_a"), F.col("id_a.line").alias("line_a"), F.col("id_b.path").alias("doc_b"), F.col("id_b.line").alias("line_b"), "n_shared")


@query("theme_clusters", "WITH RECURSIVE " + vault.FILES.lstrip() + r""",
s AS MATERIALIZED (SELECT doc_id AS o, workspace AS g, path, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{5,}')) AS ws FROM files),
w AS (SELECT o, g, len(ws) AS n, unnest(ws) AS w FROM s),
e AS MATERIALIZED (SELECT a.g, a.o AS a, b.o AS b FROM w a JOIN w b ON a.g = b.g AND a.w = b.w AND a.o < b.o GROUP BY ALL HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) > 0.3),""" + _first_free("s", "e") + r""",
m AS (SELECT s.g, s.o, s.path, s.ws, coalesce(min(x.s), s.o) AS seed FROM s LEFT JOIN (SELECT e.g, e.b, d.s FROM e JOIN seeds d ON e.g = d.g AND e.a = d.s) x ON x.g = s.g AND x.b = s.o GROUP BY s.g, s.o, s.path, s.ws),
c AS (SELECT g, seed, count(*)::INTEGER AS n_members, list_sort(list_distinct(flatten(list(ws))))[1:3] AS kw FROM m GROUP BY g, seed),
l AS (SELECT *, CASE WHEN len(kw) > 0 THEN array_to_string(kw, '-') ELSE 'misc' END AS label FROM c),
z AS (SELECT *, row_number() OVER (PARTITION BY g, label ORDER BY seed DESC) AS r FROM l)
SELECT z.g AS workspace, s.path AS seed, label, n_members FROM z JOIN s ON s.g = z.g AND s.o = z.seed WHERE r = 1""")
def theme_clusters(spark, sf_dir):
    files = vault.files(spark, sf_dir)
    return joins.themes(files.select("workspace", "path", "text", F.col("doc_id").alias("ord")), within="workspace").select("workspace", "seed", "label", F.size("members").alias("n_members"))


@query("prune_expired_superseded", "WITH " + vault.ENTRIES + r""",
m AS (SELECT doc_id, line, text || CASE WHEN line % 3 = 0 THEN ' valid_until: ' || strftime(DATE '2024-05-01' + ((doc_id + line) % 160)::INTEGER, '%Y-%m-%d') WHEN line % 5 = 0 THEN ' (Superseded by another)' ELSE '' END AS text FROM entries)
SELECT doc_id, line, CASE WHEN regexp_extract(text, '(?i)valid[_-]?until:\s*(\d{4}-\d{2}-\d{2})', 1) <> '' AND regexp_extract(text, '(?i)valid[_-]?until:\s*(\d{4}-\d{2}-\d{2})', 1) < '2024-07-19' THEN 'expired' ELSE 'superseded' END AS reason
FROM m WHERE (regexp_extract(text, '(?i)valid[_-]?until:\s*(\d{4}-\d{2}-\d{2})', 1) <> '' AND regexp_extract(text, '(?i)valid[_-]?until:\s*(\d{4}-\d{2}-\d{2})', 1) < '2024-07-19') OR regexp_matches(text, '(?i)\((?:superseded|deprecated|obsolete)\b')""")
def prune_expired_superseded(spark, sf_dir):
    until = F.date_format(F.date_add(F.lit("2024-05-01").cast("date"), ((F.col("doc_id") + F.col("line")) % 160).cast("int")), "yyyy-MM-dd")
    marked = F.concat("text", F.when(F.col("line") % 3 == 0, F.concat(F.lit(" valid_until: "), until)).when(F.col("line") % 5 == 0, " (Superseded by another)").otherwise(""))
    e = vault.entries(spark, sf_dir).withColumn("text", marked)
    reason = F.when(maintenance.expired("text", vault.TODAY), "expired").when(maintenance.superseded("text"), "superseded")
    return e.select("doc_id", "line", reason.alias("reason")).filter("reason is not null")


@query("prune_near_dup", "WITH RECURSIVE " + vault.ENTRIES.lstrip() + r""",
l AS MATERIALIZED (SELECT doc_id AS g, line AS o, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{4,}')) AS ws FROM entries),
w AS (SELECT g, o, len(ws) AS n, unnest(ws) AS w FROM l),
e AS MATERIALIZED (SELECT a.g, a.o AS a, b.o AS b FROM w a JOIN w b ON a.g = b.g AND a.w = b.w AND a.o < b.o GROUP BY ALL HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.85),
d AS MATERIALIZED (SELECT g, a AS o FROM e UNION SELECT g, b FROM e),""" + _first_free("d", "e") + """
SELECT d.g AS doc_id, d.o AS line, 'duplicate-newer-dropped' AS reason FROM d ANTI JOIN seeds ON seeds.g = d.g AND seeds.s = d.o""")
def prune_near_dup(spark, sf_dir):
    e = vault.entries(spark, sf_dir).select("doc_id", "line", "text")
    return maintenance.prune(e, vault.TODAY, group="doc_id").filter("reason is not null").select("doc_id", "line", "reason")


@query("salvage_antijoin", "WITH " + vault.ENTRIES + rf""",
h AS (SELECT doc_id, line, tag, sha1(lower(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')))) AS hash, length(regexp_replace(trim(text), '(?i)^\s*[-*]\s+\[[a-z-]+\]\s*', '')) AS n FROM entries),
stored AS (SELECT DISTINCT hash FROM h WHERE tag = 'ref'),
fresh AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, line) AS r FROM h WHERE tag <> 'ref' AND n >= 20 AND hash NOT IN (SELECT hash FROM stored))
SELECT doc_id, line, hash FROM fresh WHERE r = 1""")
def salvage_antijoin(spark, sf_dir):
    e = vault.entries(spark, sf_dir)
    return joins.salvage(e.filter("tag <> 'ref'"), e.filter("tag = 'ref'"), order=("doc_id", "line")).select("doc_id", "line", "hash")


@query("orphan_rows", "WITH " + vault.CHUNKS + r""",
present AS (SELECT path FROM files WHERE doc_id % 3 <> 0), archived AS (SELECT regexp_replace(regexp_replace('.archive/topics/' || workspace || '/' || topic || '/' || regexp_replace(list_last(string_split(path, '/')), '\.md$', '') || '-1700000000.md.gz', '^.*/', ''), '-\d{9,}\.md\.gz$', '') AS stem FROM files WHERE doc_id % 6 = 0),
deleted AS (SELECT path FROM files WHERE doc_id % 9 = 0),
gone AS (SELECT path, count(*) AS n FROM chunks WHERE path NOT IN (SELECT path FROM present) GROUP BY path)
SELECT path, n AS rows, (regexp_replace(list_last(string_split(path, '/')), '\.md$', '') IN (SELECT stem FROM archived) OR path IN (SELECT path FROM deleted)) AS recoverable FROM gone""")
def orphan_rows(spark, sf_dir):
    f = vault.files(spark, sf_dir)
    stem = F.regexp_replace(paths.name("path"), r"\.md$", "")
    archived = f.filter("doc_id % 6 = 0").select(F.concat(F.lit(".archive/topics/"), "workspace", F.lit("/"), "topic", F.lit("/"), stem, F.lit("-1700000000.md.gz")).alias("path"))
    return index.orphans(vault.chunks(spark, sf_dir), f.filter("doc_id % 3 <> 0"), archived, f.filter("doc_id % 9 = 0"))


_SLUG_LINK = "'[[' || workspace || ':topic-' || (doc_id % 40) || '#part|shown]] and [[topic-' || (doc_id % 60) || ']] and [[alias-' || (doc_id % 50) || ']]'"


@query("wikilink_parse", "WITH " + vault.FILES + rf""",
t AS (SELECT doc_id, unnest([0, 1, 2]) AS pos, unnest([workspace, NULL, NULL]) AS target_ws, unnest(['topic-' || (doc_id % 40), 'topic-' || (doc_id % 60), 'alias-' || (doc_id % 50)]) AS slug, unnest(['part', NULL, NULL]) AS section, unnest(['shown', NULL, NULL]) AS alias FROM files)
SELECT doc_id, pos::INTEGER AS pos, target_ws, slug, section, alias FROM t""")
def wikilink_parse(spark, sf_dir):
    f = vault.files(spark, sf_dir).select("doc_id", F.expr(_SLUG_LINK).alias("text"))
    return joins.wikilinks(f, ["doc_id"]).select("doc_id", "pos", "target_ws", "slug", "section", "alias")


def _catalog(spark, sf_dir):
    f = vault.files(spark, sf_dir)
    slugs = f.select("workspace", F.expr("'topic-' || (doc_id % 30)").alias("slug"), "path", F.array(F.expr("'alias-' || (doc_id % 20)")).alias("aliases"))
    return f, index.first_wins(slugs, ["workspace", "slug"], "path")


_CATALOG = vault.FILES + r""",
sl AS (SELECT workspace, 'topic-' || (doc_id % 30) AS slug, path, 'alias-' || (doc_id % 20) AS alias FROM files),
slugs AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY workspace, slug ORDER BY path) AS r FROM sl) WHERE r = 1)"""


@query("slug_catalog_first_wins", "WITH " + _CATALOG + " SELECT workspace, slug, path, alias FROM slugs")
def slug_catalog_first_wins(spark, sf_dir):
    return _catalog(spark, sf_dir)[1].select("workspace", "slug", "path", F.col("aliases")[0].alias("alias"))


@query("wikilink_resolve", "WITH " + _CATALOG + r""",
l AS (SELECT doc_id, workspace AS ws, unnest([0, 1, 2])::INTEGER AS pos, unnest(['topic-' || (doc_id % 40), 'topic-' || (doc_id % 60), 'alias-' || (doc_id % 50)]) AS slug FROM files),
c AS (SELECT workspace, slug, path, 6 AS rank FROM slugs UNION ALL SELECT workspace, alias, path, 7 FROM slugs),
b AS (SELECT workspace, slug, arg_min(path, (rank, path)) AS path FROM c GROUP BY workspace, slug)
SELECT l.doc_id, l.pos, b.path, b.path IS NULL AS broken FROM l LEFT JOIN b ON l.ws = b.workspace AND l.slug = b.slug""")
def wikilink_resolve(spark, sf_dir):
    f, slugs = _catalog(spark, sf_dir)
    links = joins.wikilinks(f.select("doc_id", F.col("workspace").alias("ws"), F.expr(_SLUG_LINK).alias("text")), ["doc_id", "ws"])
    return joins.resolve(links, slugs, f).select("doc_id", "pos", "path", "broken")


_ROUTE_STOP = ", ".join(f"'{w}'" for w in joins.ROUTING_STOPWORDS)


@query("route_argmax", "WITH " + vault.FILES + rf""",
kw AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{4,}}')), lambda w: NOT list_contains([{_ROUTE_STOP}], w)) AS kw FROM files),
bw AS (SELECT item_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{4,}}')), lambda w: NOT list_contains([{_ROUTE_STOP}], w))) AS w FROM benchmark),
tw AS (SELECT doc_id, unnest(kw) AS w FROM kw),
c AS (SELECT item_id, doc_id, count(*) AS n FROM bw JOIN tw USING (w) GROUP BY 1, 2),
b AS (SELECT item_id, arg_max(doc_id, (n, -doc_id)) AS doc_id, max(n) AS n FROM c GROUP BY item_id)
SELECT item_id, 'topic-' || doc_id AS slug, n AS overlap FROM b WHERE n >= 3""")
def route_argmax(spark, sf_dir):
    topics = vault.files(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.concat(F.lit("topic-"), F.col("doc_id").cast("string")).alias("slug"), "text")
    items = vault.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return joins.route(items, topics).filter("overlap >= 3").select(F.col("id").alias("item_id"), "slug", "overlap")


@query("append_decisions")
def append_decisions(spark, sf_dir):
    topics = vault.files(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.concat(F.lit("topic-"), F.col("doc_id").cast("string")).alias("slug"), "text")
    items = vault.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("- ["), vault.nine_tag(F.col("item_id")), F.lit("] "), "text").alias("text"))
    chunks = vault.chunks(spark, sf_dir).select("tag", text.chunk_hash("content").alias("hash"))
    return joins.append_decisions(items, topics, chunks).groupBy("status", "reason").agg(F.count("*").alias("n"))


@query("keep_newest_k", "WITH " + vault.FILES + " SELECT path, row_number() OVER (PARTITION BY workspace, topic ORDER BY list_last(string_split(path, '/')) DESC, path DESC) <= 3 AS is_newest FROM files")
def keep_newest_k(spark, sf_dir):
    from ..operators import ranking

    return ranking.keep_newest(vault.files(spark, sf_dir), 3, ["workspace", "topic"], F.desc(paths.name("path")), F.desc("path")).select("path", "is_newest")


@query("ttl_candidates", "WITH " + vault.FILES + ", r AS (SELECT path, aspect_date, row_number() OVER (PARTITION BY workspace, topic ORDER BY list_last(string_split(path, '/')) DESC, path DESC) AS n FROM files) SELECT path, date_diff('day', aspect_date, DATE '2024-07-19')::INTEGER AS age_days FROM r WHERE n > 3 AND date_diff('day', aspect_date, DATE '2024-07-19') > 90")
def ttl_candidates(spark, sf_dir):
    return maintenance.aspect_candidates(vault.files(spark, sf_dir), vault.TODAY).select("path", dates.days_before("aspect_date", vault.TODAY).alias("age_days"))


@query("journal_candidates", "WITH " + vault.FILES + ", j AS (SELECT 'workspaces/' || workspace || '/journal/' || doc_id || '.md' AS path, mtime, size * 20 AS size FROM files) SELECT path FROM j WHERE 1721347200 - mtime > 7 * 86400 OR (size > 75000 AND 1721347200 - mtime > 86400)")
def journal_candidates(spark, sf_dir):
    j = vault.files(spark, sf_dir).select(F.concat(F.lit("workspaces/"), "workspace", F.lit("/journal/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "mtime", (F.col("size") * 20).alias("size"))
    return maintenance.journal_candidates(j, vault.NOW, vault.TODAY).select("path")


_HEADED = "'---' || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'type: aspect' || chr(10) || 'date: 2024-01-01' || chr(10) || 'topic: ' || topic || chr(10) || 'slug: x' || chr(10) || 'title: X' WHEN 1 THEN 'type: note' || chr(10) || 'topic: ' || topic WHEN 2 THEN 'slug:' ELSE 'title: only' END || chr(10) || '---' || chr(10)"


@query("validator_issues", "WITH " + vault.FILES + r""",
i AS (SELECT path, CASE doc_id % 5 WHEN 4 THEN ['missing-frontmatter'] ELSE CASE doc_id % 4
  WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['missing-field:date', 'missing-field:slug', 'missing-field:title', 'wrong-type:note!=aspect']
  WHEN 2 THEN ['missing-field:type', 'missing-field:date', 'missing-field:topic', 'missing-field:slug', 'missing-field:title']
  ELSE ['missing-field:type', 'missing-field:date', 'missing-field:topic', 'missing-field:slug'] END END AS issues FROM files)
SELECT path, array_to_string(issues, ' ') AS issues FROM i WHERE len(issues) > 0""")
def validator_issues(spark, sf_dir):
    f = vault.files(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 5 == 4, F.lit("no header")).otherwise(F.expr(_HEADED.replace("chr(10)", "'\\n'"))))
    return f.select("path", F.array_join(maintenance.issues("path", "text"), " ").alias("issues")).filter("issues <> ''")


@query("front_matter", "WITH " + vault.FILES + r""" SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'aspect' WHEN 1 THEN 'note' END AS type, CASE WHEN doc_id % 4 < 2 THEN topic END AS topic, CASE doc_id % 2 WHEN 0 THEN 'a-' || topic || ' b' ELSE '' END AS tags FROM files""")
def front_matter(spark, sf_dir):
    head = F.concat(F.expr(_HEADED.replace("chr(10)", "'\\n'")))
    with_tags = F.regexp_replace(head, "^---\n", F.concat(F.lit("---\n"), F.expr("CASE doc_id % 2 WHEN 0 THEN 'tags: [A-' || topic || ', \"b\"]\n' ELSE '' END")))
    f = vault.files(spark, sf_dir).select("doc_id", F.concat(with_tags, "text").alias("text"))
    m = source.front("text")
    return f.select("doc_id", m["type"].alias("type"), m["topic"].alias("topic"), F.array_join(source.front_tags("text"), " ").alias("tags"))


@query("tier_classify", r"""
WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'workspaces/' || source || '/journal/2024-07-19.md' WHEN 1 THEN 'workspaces/' || source || '/journal/2024-01-02.md' WHEN 2 THEN 'workspaces/' || source || '/skills/a.md' WHEN 3 THEN 'workspaces/' || source || '/docs/handoff.md' WHEN 4 THEN 'shared/tools.md' ELSE 'workspaces/' || source || '/' || lang || '/2024-01-01-x.md' END AS path FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'working' WHEN 1 THEN 'episodic' WHEN 2 THEN 'procedural' WHEN 3 THEN 'working' ELSE 'semantic' END AS tier, CASE doc_id % 6 WHEN 0 THEN 'journal' WHEN 1 THEN 'journal' WHEN 2 THEN 'topic' WHEN 3 THEN 'handoff' WHEN 4 THEN 'shared' ELSE 'aspect' END AS bucket FROM f""")
def tier_classify(spark, sf_dir):
    path = F.expr("CASE doc_id % 6 WHEN 0 THEN 'workspaces/' || source || '/journal/2024-07-19.md' WHEN 1 THEN 'workspaces/' || source || '/journal/2024-01-02.md' WHEN 2 THEN 'workspaces/' || source || '/skills/a.md' WHEN 3 THEN 'workspaces/' || source || '/docs/handoff.md' WHEN 4 THEN 'shared/tools.md' ELSE 'workspaces/' || source || '/' || lang || '/2024-01-01-x.md' END")
    d = vault.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return d.select("doc_id", paths.tier("path", vault.TODAY).alias("tier"), paths.bucket("path").alias("bucket"))


@query("typed_entries", "WITH " + vault.ENTRIES + " SELECT doc_id, count(*)::INTEGER AS n_entries FROM entries GROUP BY doc_id")
def typed_entries(spark, sf_dir):
    joined = vault.entries(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), "\n").alias("t"))
    return joined.select("doc_id", lines.typed_entry_count("t").alias("n_entries"))


@query("migration_plan", "WITH " + vault.FILES + r""",
o AS (SELECT doc_id, workspace, topic, mtime, CASE doc_id % 5 WHEN 0 THEN 'workspaces/' || workspace || '/note-' || doc_id || '.md' WHEN 1 THEN 'workspaces/' || workspace || '/t' || doc_id || '/t' || doc_id || '.md' WHEN 2 THEN 'workspaces/' || workspace || '/t1/side-' || doc_id || '.md' WHEN 3 THEN 'workspaces/' || workspace || '/docs/x.md' ELSE path END AS src FROM files)
SELECT src, CASE doc_id % 5 WHEN 0 THEN 'flat-to-folder' WHEN 1 THEN 'folder-note-to-readme' WHEN 2 THEN 'sibling-to-aspect' WHEN 3 THEN 'skip' ELSE 'keep-aspect' END AS action,
  CASE doc_id % 5 WHEN 0 THEN 'workspaces/' || workspace || '/note-' || doc_id || '/00-README.md' WHEN 1 THEN 'workspaces/' || workspace || '/t' || doc_id || '/00-README.md' WHEN 2 THEN 'workspaces/' || workspace || '/t1/' || strftime(make_timestamp(mtime::BIGINT * 1000000), '%Y-%m-%d') || '-side-' || doc_id || '.md' END AS dst FROM o""")
def migration_plan(spark, sf_dir):
    src = F.expr("CASE doc_id % 5 WHEN 0 THEN 'workspaces/' || workspace || '/note-' || doc_id || '.md' WHEN 1 THEN 'workspaces/' || workspace || '/t' || doc_id || '/t' || doc_id || '.md' WHEN 2 THEN 'workspaces/' || workspace || '/t1/side-' || doc_id || '.md' WHEN 3 THEN 'workspaces/' || workspace || '/docs/x.md' ELSE path END")
    return maintenance.migration_plan(vault.files(spark, sf_dir).select("workspace", "mtime", src.alias("path")))

