"""Ranked recall: query profile, column-weighted BM25, filters, collapse by path, top k."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from ..functions import text
from ..session import written
from . import index, tags

K1, B = 1.2, 0.75
MAX_TERMS = 12

#: What a query asks for, first match wins, and words about time.
TYPE_CUES = (
    ("decision", r"why did we|why do we|decid\w*|chose|choose|chosen|rationale|tradeoff|trade-off"),
    ("exp", r"broke|broken|bug|failed|failure|mistake|lesson|postmortem|regress\w*|went wrong|why didn't"),
    ("skill-ref", r"how do i|how to|how does|steps|workflow|procedure|runbook|recipe"),
    ("tool", r"version|command|flag|cli|install\w*|upgrade"),
    ("goal", r"goal|objective|target|aiming|plan to"),
    ("hypothesis", r"unverified|assumption|hypothesis|suspect|might be"),
    ("ref", r"what is|what are|define|definition|fact|source|reference"),
)
TEMPORAL = (
    r"today|yesterday|tomorrow|tonight|last\s+(?:week|month|year|time|session)|this\s+(?:week|month|year)|recent\w*|latest|newest|current\w*|lately|"
    r"when|before|after|since|until|ago|earlier|previous\w*|\d{4}-\d{2}-\d{2}|v\d+(?:\.\d+)+"
)


@dataclass(frozen=True)
class Profile:
    subject: str
    keywords: tuple[str, ...]
    answer_type: str
    temporal: bool
    boundary: int | None


def profile(query: str, days: int = 0, stop: frozenset[str] | None = None) -> Profile:
    """What a query is about: identifiers first, then prose words that say something (are not in ``stop``)."""
    stop = tags.stopwords() if stop is None else stop
    idents, prose = tags.harvest(query or "")
    words = [w.lower() for w in tags.PROSE_WORD.findall(prose)]
    keywords: dict[str, str] = {}
    for w in [*idents, *(w for w in words if w not in stop and len(w) >= 3 and not w.isdigit())]:
        keywords.setdefault(w.lower(), w)
    found = tuple(keywords.values())
    kind = next((k for k, cue in TYPE_CUES if re.search(rf"\b({cue})\b", query or "", re.I)), "")
    return Profile(idents[0] if idents else max(found, key=len, default=""), found, kind, bool(re.search(rf"\b({TEMPORAL})\b", query or "", re.I)), days if days > 0 else None)


def answer_type(query: str | Column) -> Column:
    """The answer type of a column of queries."""
    q, out = text.col(query), None
    for kind, cue in TYPE_CUES:
        hit = q.rlike(rf"(?i)\b({cue})\b")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("")


def match_terms(prof: Profile) -> list[list[str]]:
    """The phrases of a match expression: at most 12 terms of two characters or more, each as its tokens."""
    out = []
    for word in prof.keywords:
        cleaned = " ".join(re.sub(r'["*^:()\[\]{}]', " ", word).split())
        if len(cleaned) >= 2:
            marked, plain = text.fold_table()
            out.append(re.findall(r"[^\W_]+", cleaned.lower().translate(str.maketrans(marked, plain))))
    return [t for t in out[:MAX_TERMS] if t]


def phrase_count(tokens: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    last = F.size(tokens) - (len(phrase) - 1)

    def here(i: Column) -> Column:
        hit = F.element_at(tokens, i) == phrase[0]
        for j, p in enumerate(phrase[1:], 1):
            hit = hit & (F.element_at(tokens, i + j) == p)
        return hit

    return F.when(last >= 1, F.size(F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), here))).otherwise(0)


def bm25(chunks: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """``chunks`` that hold any of the phrases, with score (smaller is better).

    Statistics are of all chunks given, so filters belong after it; they are one row.  Tokens are counted without
    being taken apart but where a column holds all of a phrase's terms.
    """
    cols = list(index.WEIGHTS)

    def weight(f: Column, c: str, p: list[str]) -> Column:
        holds = F.lit(True)
        for t in p:
            holds = holds & F.contains(f[c], F.lit(t))
        tokens = F.regexp_extract_all(f[c], F.lit(text.TOKEN), 0)
        return F.when(holds, F.lit(index.WEIGHTS[c]) * text.let(tokens, lambda ts: phrase_count(ts, p))).otherwise(0.0)

    def count(f: Column) -> Column:
        by_phrase = [sum((weight(f, c, p) for c in cols[1:]), weight(f, cols[0], p)) for p in phrases]
        return F.struct(sum((F.regexp_count(f[c], F.lit(text.TOKEN)) for c in cols[1:]), F.regexp_count(f[cols[0]], F.lit(text.TOKEN))).alias("n_tokens"), *(x.alias(f"f_{i}") for i, x in enumerate(by_phrase)))

    folded = F.struct(*(text.folded(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in cols))
    counted = text.computed_once(chunks, "__k", text.let(folded, count)).select(*chunks.columns, "__k.*")
    stats = counted.agg(F.count("*").alias("N"), (F.sum("n_tokens") / F.count("*")).alias("avgdl"), *(F.count_if(F.col(f"f_{i}") > 0).alias(f"n_{i}") for i in range(len(phrases))))
    hit = F.lit(False)
    for i in range(len(phrases)):
        hit = hit | (F.col(f"f_{i}") > 0)
    rows = counted.filter(hit).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.log((F.col("N") - F.col(f"n_{i}") + 0.5) / (F.col(f"n_{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"f_{i}")
        score = score + idf * (f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_tokens") / F.col("avgdl"))))
    return rows.select(*chunks.columns, (-score).alias("score"))


def _column_weight() -> Column:
    return F.element_at(F.create_map(*(x for c, w in index.WEIGHTS.items() for x in (F.lit(c), F.lit(w)))), F.col("col"))


def _idf(chunks: Column, holding: Column) -> Column:
    idf = F.log((chunks - holding + 0.5) / (holding + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf)


def _saturated(f: Column, n_tokens: Column, mean: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * n_tokens / mean))


def bm25_indexed(postings: DataFrame, lengths: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """chunk_id, score from postings: of the query's terms only, with statistics of the given lengths."""
    terms = sorted({t for p in phrases for t in p})
    hits = postings.filter(F.col("term").isin(*terms))
    stats = lengths.agg(F.count("*").alias("N"), (F.sum("n_tokens") / F.count("*")).alias("avgdl"))
    return _scored(hits, phrases, F.col("N"), F.col("avgdl"), stats)


def bm25_stored(stored: index.StoredIndex, phrases: list[list[str]]) -> DataFrame:
    """chunk_id, score from a stored index: reads the buckets of the query's terms, and no text, length or other term."""
    hits = stored.postings_of(t for p in phrases for t in p)
    return _scored(hits, phrases, F.lit(stored.chunks), F.lit(stored.mean_length))


def _scored(hits: DataFrame, phrases: list[list[str]], chunks: Column, mean: Column, stats: DataFrame | None = None) -> DataFrame:
    by_col = hits.groupBy("chunk_id", "col", "n_tokens").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"))  # at most the query's terms
    empty = F.array().cast("array<int>")

    def count(p: list[str]) -> Column:
        if len(p) == 1:
            return F.size(F.coalesce(F.try_element_at("m", F.lit(p[0])), empty))
        at = F.coalesce(F.try_element_at("m", F.lit(p[0])), empty)
        rest = [F.coalesce(F.try_element_at("m", F.lit(t)), empty) for t in p[1:]]

        def follows(i: Column) -> Column:
            ok = F.lit(True)
            for j, r in enumerate(rest, 1):
                ok = ok & F.array_contains(r, i + j)
            return ok

        return F.size(F.filter(at, follows))

    weighted = by_col.select("chunk_id", "n_tokens", *((_column_weight() * count(p)).alias(f"f_{i}") for i, p in enumerate(phrases)))
    per_chunk = weighted.groupBy("chunk_id", "n_tokens").agg(*(F.sum(f"f_{i}").alias(f"f_{i}") for i in range(len(phrases))))
    rows = per_chunk.crossJoin(F.broadcast(per_chunk.agg(*(F.count_if(F.col(f"f_{i}") > 0).alias(f"n_{i}") for i in range(len(phrases))))))  # one row
    if stats is not None:
        rows = rows.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(phrases)):
        score = score + _idf(chunks, F.col(f"n_{i}")) * _saturated(F.col(f"f_{i}"), F.col("n_tokens"), mean)
    return rows.select("chunk_id", (-score).alias("score")).filter("score < 0")


def query_phrases(query: str | Column) -> Column:
    """The phrases of each of a column of queries, as ``match_terms`` of its profile has them; null for a null query."""
    stop = tags.stopwords()

    @F.udf("array<array<string>>", useArrow=True)
    def of(q):
        return None if q is None else match_terms(profile(q, stop=stop))

    return of(text.col(query))


def bm25_batch(stored: index.StoredIndex, queries: DataFrame, k: int = 10, deals: int = 16) -> DataFrame:
    """item_id, chunk_id, score, rank: the k best chunks of the index for each of a table of queries (item_id, phrases).

    The queries' distinct terms meet the postings once, whatever many queries ask for them; what a phrase finds is dealt
    in ``deals`` parts by chunk before it meets the queries, as a frequent phrase may be in every chunk and in every query.
    Best lists are cut to k in each task before they are shuffled.  A null or empty list of phrases finds nothing; a
    phrase that a query has twice counts twice, as in a single query.
    """
    asked = queries.select("item_id", F.explode("phrases").alias("phrase")).withColumn("key", F.array_join("phrase", " "))
    distinct = asked.select("key", "phrase").distinct()
    terms = distinct.select("key", F.size("phrase").alias("n"), F.posexplode("phrase").alias("j", "term")).withColumn("part", index.bucket(F.col("term"), F.lit(stored.buckets)))
    hits = stored.postings.join(terms, ["part", "term"]).withColumn("weight", _column_weight())
    by_chunk = ["key", "chunk_id", "n_tokens"]
    words = hits.filter("n = 1").groupBy(*by_chunk).agg(F.sum(F.col("weight") * F.col("tf")).alias("f"))
    starts = hits.filter("n > 1").select(*by_chunk, "n", "col", "weight", F.explode(F.transform("positions", lambda p: p - F.col("j"))).alias("start"))
    whole = starts.groupBy(*by_chunk, "n", "col", "weight", "start").agg(F.count("*").alias("met")).filter("met = n")
    found = words.unionByName(whole.groupBy(*by_chunk).agg(F.sum("weight").alias("f")))
    counted = asked.groupBy("item_id", "key").agg(F.count("*").alias("times")).join(found.groupBy("key").agg(F.count("*").alias("holding")), "key")
    wanted = counted.select("item_id", "key", (F.col("times") * _idf(F.lit(stored.chunks), F.col("holding"))).alias("idf"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    dealt = found.withColumn("deal", F.pmod(F.xxhash64("chunk_id"), F.lit(deals)).cast("int"))
    part = -F.col("idf") * _saturated(F.col("f"), F.col("n_tokens"), F.lit(stored.mean_length))
    scored = dealt.join(wanted, ["key", "deal"]).groupBy("item_id", "chunk_id").agg(F.sum(part).alias("score"))
    best = Window.partitionBy("item_id").orderBy("score", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def filters(workspace: str = "", tag: str = "", keyword: str = "", topic: str = "", days: int = 0, now: float = 0.0, archived: bool = False) -> Column:
    """The row filters of a recall; empty values filter nothing."""
    path = F.lower("path")
    keep = path.like(".archive/%") if archived else ~path.like(".archive/%")
    if workspace and workspace != "*":
        w = workspace.lower()
        keep = keep & (path.like(f"%/{w}/%") if archived else path.like("shared/%") if w == "shared" else path.like(f"workspaces/{w}/%"))
    if tag:
        keep = keep & (F.col("tag") == tag)
    if keyword:
        keep = keep & F.lower("keywords").like(f"%{keyword.lower()}%")
    if topic:
        keep = keep & path.like(f"%/{topic.lower()}/%")
    if days > 0:
        keep = keep & (F.col("mtime") >= now - days * 86400)
    return keep


def collapse(ranked: DataFrame, *order: str | Column) -> DataFrame:
    """The best chunk of each path."""
    return ranked.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy(*order))).filter("__n = 1").drop("__n")


def recall(chunks: DataFrame, query: str, limit: int = 10, collapse_paths: bool = True, **where) -> DataFrame:
    """The best chunks for a query; the most recent ones for an empty query; an error for one without terms."""
    if not query.strip():
        rows = chunks.filter(filters(**where)).withColumn("score", F.lit(0.0))
        rows = collapse(rows, F.desc("mtime"), F.desc("chunk_id")) if collapse_paths else rows
        return rows.orderBy(F.desc("mtime"), F.desc("chunk_id")).limit(limit)
    phrases = match_terms(profile(query))
    if not phrases:
        raise ValueError("no searchable terms")
    rows = bm25(chunks, phrases).filter(filters(**where))
    if collapse_paths:
        rows = collapse(rows, "score", "chunk_id")
    return rows.orderBy("score", "chunk_id").limit(limit)


def fuzzy(docs: DataFrame, query: str, k: int = 10, least: float = 0.15, n: int = 3, text_col: str = "text", order: str = "doc_id") -> DataFrame:
    """The k texts nearest to a query by n-gram Jaccard."""
    q = F.lit(query)
    rows = text.computed_once(docs, "score", text.jaccard(text.char_ngrams(text_col, n), text.char_ngrams(q, n))).filter(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), order).limit(k)


#: N-grams of queries that go to the texts in one pass; a query larger than that has a pass of its own.
PASS_GRAMS = 2_000_000


def _nearest_in(asked: list, d: DataFrame, item: DataType, doc: DataType, k: int, least: float) -> DataFrame:
    """item_id, doc_id, score: of texts (doc_id, g) and one pass of queries, pairs of at least ``least``, at most the k best of a query from a batch and equals of the last."""
    items = [r["item_id"] for r in asked]
    sizes = np.array([len(r["g"]) for r in asked])
    grams, places = np.unique(np.concatenate([np.array(r["g"], dtype=object) for r in asked]), return_inverse=True)
    by_gram = np.argsort(places, kind="stable")
    index_ = d.sparkSession.sparkContext.broadcast((items, sizes, list(grams), np.repeat(np.arange(len(items)), sizes)[by_gram], np.searchsorted(places[by_gram], np.arange(len(grams) + 1))))
    schema = StructType([StructField("item_id", item), StructField("doc_id", doc), StructField("score", DoubleType())])

    def run(batches):
        items, sizes, grams, holders, starts = index_.value
        known = pa.array(grams, pa.string())
        for batch in batches:
            lists = batch.column("g")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            found = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
            who, where, score = [], [], []
            for row in range(len(lists)):
                n = offsets[row + 1] - offsets[row]
                here = found[offsets[row] : offsets[row + 1]]
                here = here[here >= 0]
                if len(here) < n * least - 1e-9:
                    continue  # too few of its n-grams are anywhere in the queries
                common = np.bincount(np.concatenate([holders[starts[g] : starts[g + 1]] for g in here]), minlength=len(items))
                near = common / (sizes + n - common)
                hit = np.flatnonzero(near >= least)
                who.append(hit)
                where.append(np.full(len(hit), row))
                score.append(near[hit])
            if who:
                who, where, score = map(np.concatenate, (who, where, score))
                order = np.lexsort((-score, who))
                first = np.searchsorted(who[order], who[order])
                floor = score[order][np.minimum(first + k - 1, len(order) - 1)]
                last = who[order][np.minimum(first + k - 1, len(order) - 1)]
                order = order[(last != who[order]) | (score[order] >= floor)]
                yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in who[order]], to_arrow_type(item)), batch.column("doc_id").take(pa.array(where[order])), pa.array(score[order])], names=schema.names)

    return d.mapInArrow(run, schema)


def fuzzy_join(queries: DataFrame, docs: DataFrame, k: int = 3, least: float = 0.15, n: int = 3) -> DataFrame:
    """item_id, doc_id, score, rank: the k nearest texts of each query (item_id, q), by n-grams, of at least ``least``.

    Queries go to the texts as inverted lists, in passes of about PASS_GRAMS n-grams, so what is broadcast is bounded
    however many they are.  A text adds up the lists of its own n-grams: the work is what texts and queries share, not their product, no
    set is compared with another and no n-gram of a text is shuffled.  Texts of a size that cannot be as near as ``least`` to any query
    of the pass are not looked at, and pairs that k better ones of a batch push out stay in it.  Null and short texts have no
    n-grams and are near to nothing; rows with equal ids are rows of their own among texts.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    q = written(queries.select("item_id", text.char_ngrams("q", n).alias("g")).filter(F.size("g") > 0), "queries")
    passes = max(1, math.ceil((q.agg(F.sum(F.size("g"))).first()[0] or 0) / PASS_GRAMS))
    d = text.computed_once(docs.select("doc_id", "text"), "g", text.char_ngrams("text", n)).select("doc_id", "g").filter(F.size("g") > 0)
    item, doc = q.schema["item_id"].dataType, d.schema["doc_id"].dataType
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = q.sparkSession.createDataFrame([], StructType([StructField("item_id", item), StructField("doc_id", doc), StructField("score", DoubleType())]))
    for i in range(passes):
        asked = q.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i).collect()  # about PASS_GRAMS n-grams
        if asked:
            sizes = [len(r["g"]) for r in asked]
            able = d.filter((F.size("g") >= min(sizes) * least - 1e-9) & (F.size("g") * least <= max(sizes) + 1e-9))
            found = found.unionByName(_nearest_in(asked, able, item, doc, k, least))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def cosine_topk(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """Extension: the k vectors of largest cosine to one query vector."""
    q = F.array(*map(F.lit, query))
    dot = F.aggregate(F.zip_with("embedding", q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn("score", dot / (norm * math.sqrt(sum(x * x for x in query)))).orderBy(F.desc("score"), "vec_id").limit(k)
