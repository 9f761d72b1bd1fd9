"""The pipeline against its parts, on the smallest tables."""

import zlib

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from lorekeep.llm import pii, registry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF))
    for before, after in zip(kept[:-1], kept[1:-1]):
        assert after.columns == before.columns
    good, single, private, mixed, encoded = (df.collect() for df in kept[1:])
    ids = lambda rows: {r.doc_id for r in rows}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1 and i in ids(kept[0].collect())]
    assert sum((i in ids(good)) == bool(labels[i]) for i in held) >= 0.9 * len(held)
    assert ids(single) < ids(good) and len(single) == len(ids(single))
    assert ids(private) == ids(single)
    texts = {r.doc_id: r.text for r in single}
    for r in private:
        old = {texts[r.doc_id][a:b] for a, b, _, _ in pii.detect(texts[r.doc_id])}
        assert not any(o in r.text for o in old)
    assert ids(mixed) <= ids(private)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(r.n_tokens for r in encoded) == sorted(len(library.encode(r.text, add_special_tokens=False).ids) for r in mixed)


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert {n.split("_")[0] for n in registry.queries()} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert set(registry.oracle_sql()) <= set(registry.queries())


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, body string, root long, target string, taken string, row string, k string, t string, templates string, __entities int"


def odd_documents(spark):
    """Null, empty, very long, repeated and near-copied texts, null ids and sources, and columns of any name."""
    prose = [" ".join(f"word{(i * 7 + j * j) % 997}" for j in range(120)) for i in range(40)]
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(prose)]
    rows += [(100, prose[0] + " more", "en", "a"), (0, prose[0], "en", "a"), (0, prose[0], "en", "a"), (5, prose[6] + " and more", "en", None), (None, prose[7], "en", "a"), (None, "a text of its own, by nobody", None, None)]
    rows += [(200, None, "en", "a"), (201, "", "en", "b"), (202, " \n\t", None, None), (None, None, None, None), (203, "word " * 300_000 + "me@mail.example.com", "en", "a"), (204, "x" * 1_000_000, "en", "b")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "s", "b", 1, "t", "u", "r", "k", "t", "h", 7) for r in rows], ODD), rows


def key(r):
    return (str(r.doc_id), r.text or "", str(r.source))


def test_stages_on_odd_documents(spark):
    docs, rows = odd_documents(spark)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    good = corpus_pipeline.reject_low_quality(spark, docs, SF)
    assert good.columns == names
    fate = {}
    kept = [key(r) for r in good.collect()]
    for r in docs.collect():
        assert fate.setdefault(r.text or "", key(r) in kept) == (key(r) in kept)
    single = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert single.columns == names
    left = sorted(key(r) for r in single.collect())
    words = lambda t: (t or "").split()

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t, _, _ in rows]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    groups: list[set[int]] = []
    for x, (_, s) in enumerate(sets):
        met = [g for g in groups if any(near(s, sets[y][1]) for y in g)]
        groups = [g for g in groups if g not in met] + [set().union({x}, *met)]
    assert len(left) == len(groups)  # a row of each group, and nothing else goes
    private = corpus_pipeline.replace_personal_data(spark, docs, SF)
    assert private.columns == names
    texts = {r.doc_id: r.text for r in private.collect()}
    assert private.count() == len(rows) and texts[200] is None and texts[203].startswith("word word ") and "me@mail" not in texts[203] and texts[204] == "x" * 1_000_000
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == names and all(words(r.text) for r in mixed.collect()) and {r.source for r in mixed.collect()} == {"a", "b", None}
    encoded = corpus_pipeline.encode(spark, docs, SF)
    assert encoded.count() == len(rows) and {r.n_tokens for r in encoded.filter("doc_id >= 200 AND doc_id <= 202").collect()} == {0}


def test_kept_and_near_copies_make_up_the_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from lorekeep.llm import ngram_join

    n = ngram_join.join_components(docs)
    groups = n.filter("n_shingles > 0").select("component_id").distinct().count() + n.filter("n_shingles = 0").count()
    assert ngram_join.keep_one(docs).count() == groups


def test_intermediate_tables_go(spark):
    import glob

    from lorekeep.llm.common import drop_tables, tables_dir

    drop_tables(spark)
    done = corpus_pipeline.run(spark, SF)
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in glob.glob(tables_dir(spark).removeprefix("file:") + "/*")}
    assert done.count() > 0 and left <= {"pipeline-4", "join-signed", "join-classes", "join-roots", "mix-plan"}
    drop_tables(spark)
    assert not glob.glob(tables_dir(spark).removeprefix("file:") + "/*")
