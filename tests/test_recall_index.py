import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import index, joins, recall, tags


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["foo_bar", "Été", "mail7.example.com", "the"]
    rows = [(i, f"w{i % 3}", rng.choice(["ref", "", None]), rng.choice(["head one", "w3 w4"]), f"k{i % 5}", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, workspace string, tag string, heading string, keywords string, content string")
    path = str(tmp_path_factory.mktemp("index"))
    index.write_index(chunks, path, 16, 2)
    return chunks, index.open_index(spark, path)


def scores(df):
    return {r.chunk_id: r.score for r in df.collect()}


def test_a_stored_index_scores_like_the_chunks(stored):
    chunks, ix = stored
    for phrases in ([["w1"], ["foo", "bar"], ["ete"]], [["mail7", "example", "com"]], [["nowhere"]], [["w3"], ["w3"]]):
        a, b = scores(recall.bm25_stored(ix, phrases)), scores(recall.bm25(chunks, phrases))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_a_query_reads_the_buckets_of_its_terms_only(stored):
    _, ix = stored
    plan = recall.bm25_stored(ix, [["w1"], ["w2"]])._jdf.queryExecution().executedPlan().toString()
    parts = sorted({index.bucket(t, 16) for t in ("w1", "w2")})
    assert f"PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert all(str(p) in plan.split("PartitionFilters: ")[1].split("]")[0] for p in parts)
    read = ix.postings_of(["w1", "w2"])
    assert {f.split("part=")[1].split("/")[0] for f in read.inputFiles()} <= {str(p) for p in range(16)}
    terms = {r.term for r in ix.postings.select("term", "part").filter(F.col("part") == index.bucket("w1", 16)).collect()}
    assert "w1" in terms


def test_buckets_here_and_in_a_plan_agree(spark):
    terms = ["a", "été", "w1", "😀", ""]
    df = spark.createDataFrame([(t,) for t in terms], "t string").select("t", index.bucket(F.col("t"), F.lit(16)).alias("b"))
    assert {r.t: r.b for r in df.collect()} == {t: index.bucket(t, 16) for t in terms}


def test_batch_equals_one_query_at_a_time(spark, stored):
    _, ix = stored
    asked = {1: [["w1"], ["foo", "bar"]], 2: [["w5"], ["w5"], ["w6"]], 3: [["nowhere"]], 4: [], 5: [["mail7", "example", "com"], ["the"]], 6: None}
    queries = spark.createDataFrame(list(asked.items()), "item_id int, phrases array<array<string>>")
    got = recall.bm25_batch(ix, queries, 7, 3).collect()
    for item, phrases in asked.items():
        mine = sorted((r.rank, r.chunk_id, r.score) for r in got if r.item_id == item)
        alone = sorted((s, c) for c, s in scores(recall.bm25_stored(ix, phrases)).items())[:7] if phrases else []
        assert [r for r, _, _ in mine] == list(range(1, len(alone) + 1))
        assert [s for _, _, s in mine] == pytest.approx([s for s, _ in alone])


def test_an_empty_index_finds_nothing(spark, stored, tmp_path):
    chunks, _ = stored
    index.write_index(chunks.limit(0), str(tmp_path / "none"), 4)
    ix = index.open_index(spark, str(tmp_path / "none"))
    assert (ix.chunks, ix.tokens) == (0, 0)
    assert recall.bm25_stored(ix, [["w1"]]).collect() == []


def test_query_phrases_are_those_of_profiles(spark):
    texts = ["why did we drop `_forget.py` in raw_ttl_days", "của những được không vector", "", None, "the of and"]
    got = [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(recall.query_phrases("t").alias("p")).collect()]
    assert got == [None if t is None else recall.match_terms(recall.profile(t)) for t in texts]


def test_stop_words_with_and_without_accents():
    assert recall.profile("của những được không vector").keywords == ("vector",)
    assert recall.profile("why did the vector").keywords == ("vector",)
    assert {"theo", "khi", "cho", "hay", "con", "sao", "nha", "xong", "khong", "thử"} - tags.stopwords() == {"thử"}


def greedy(edges):
    """The nodes that are not free, by going through them in order."""
    earlier, gone = {}, set()
    for g, a, b in edges:
        earlier.setdefault((g, b), []).append(a)
    for g, b in sorted(earlier):
        if any((g, a) not in gone for a in earlier[g, b]):
            gone.add((g, b))
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_first_free_is_the_greedy_fold(spark, seed):
    rng = random.Random(seed)
    edges = {(g, *sorted(rng.sample(range(n), 2))) for g, n, m in (("a", 40, 60), ("b", 8, 20), ("c", 100, 60)) for _ in range(m)}
    edges |= {("chain", i, i + 1) for i in range(11)} | {("star", 0, i) for i in range(1, 200)}
    df = spark.createDataFrame([*edges, *list(edges)[:5]], "g string, a int, b int")
    assert {(r.g, r.o) for r in joins.first_free(df).collect()} == greedy(edges)
    assert joins.first_free(df.limit(0)).collect() == []


def test_fuzzy_join_equals_all_pairs_in_any_passes(spark, monkeypatch):
    rng = random.Random(6)
    draw = lambda most: " ".join("".join(rng.choices("abc", k=3)) for _ in range(rng.randint(1, most)))
    docs = [(i, draw(30)) for i in range(120)] + [(500, None), (501, ""), (502, "ab")]
    queries = [(i, draw(12)) for i in range(25)] + [(60, None), (61, ""), (62, docs[3][1])]
    grams = lambda t: {t[i : i + 3] for i in range(len(t or "") - 2)}
    expected = set()
    for item, q in queries:
        scores_ = sorted((-len(a & b) / len(a | b), i) for i, t in docs if (a := grams(t)) and (b := grams(q)))
        expected |= {(item, i, r, round(-s, 9)) for r, (s, i) in enumerate((x for x in scores_ if -x[0] >= 0.15), 1) if r <= 3}
    q, d = spark.createDataFrame(queries, "item_id int, q string"), spark.createDataFrame(docs, "doc_id int, text string")
    for grams_a_pass in (2_000_000, 300):
        monkeypatch.setattr(recall, "PASS_GRAMS", grams_a_pass)
        got = [(r.item_id, r.doc_id, r.rank, round(r.score, 9)) for r in recall.fuzzy_join(q, d).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    assert recall.fuzzy_join(q.limit(0), d).collect() == []


def test_postings_are_made_without_a_shuffle(spark):
    rows = [(7, "ref", "h", "k", "b a b"), (8, "", None, "", "")]
    made = index.build_postings(spark.createDataFrame(rows, "chunk_id long, tag string, heading string, keywords string, content string"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.term, r.col): (r.chunk_id, r.n_tokens, r.tf, r.positions) for r in made.collect()}
    assert got == {("ref", "tag"): (7, 6, 1, [0]), ("h", "heading"): (7, 6, 1, [0]), ("k", "keywords"): (7, 6, 1, [0]), ("b", "content"): (7, 6, 2, [0, 2]), ("a", "content"): (7, 6, 1, [1])}
