import zlib

import numpy as np

from lorekeep.llm import quality


def rows_of(n=900):
    rng = np.random.default_rng(3)
    words = ["the", "house", "river", "walks", "under", "green", "of", "and", "stone", "light"]
    for i in range(n):
        good = i % 3 != 0
        t = [words[j] for j in rng.integers(0, len(words), 60)]
        yield i, " ".join(t).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in t), int(good)


def test_held_out_accuracy(spark, docs_of):
    rows = list(rows_of())
    docs = docs_of([(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, quality.train(docs, labels)).collect()
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_held_out_labels_are_not_learned_from(spark, docs_of):
    rows = list(rows_of())
    docs = docs_of([(i, t, "s") for i, t, _ in rows])
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, _, q in rows]
    a = quality.train(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    b = quality.train(docs, spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert (a.value == b.value).all()


def test_odd_texts_and_few_labels(spark, docs_of):
    docs = docs_of([(1, None, "s"), (2, "", "s"), (2, "", "s"), (None, "x" * 300_000, "s")])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.classify(docs, quality.train(docs, known)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs.limit(0), quality.train(docs, labels)).collect() == []
    assert quality.keep_good(docs, quality.train(docs, labels)).columns == docs.columns


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y, trees=20)

    def walk(row):
        total = model.base
        for at in model.roots:
            while model.left[at] >= 0:
                at = model.left[at] + int(row[model.feature[at]] > model.threshold[at])
            total += model.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97


def test_repeated_ids_reach_the_driver_once(spark, docs_of):
    rows = list(rows_of(300))
    docs = docs_of([(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    once = quality.train(docs, labels)
    again = quality.train(docs.unionByName(docs).unionByName(docs), labels.unionByName(labels))
    assert (once.value == again.value).all() and (once.threshold == again.threshold).all()


def test_the_whole_query_equals_plain_python(spark):
    """Statistics, fit and scores of the smallest tables, without Spark."""
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in docs}
    x = {i: quality.statistics(t) for i, t in docs}
    known = sorted(i for i in x if i in labels and not held[i])
    model = quality.fit(np.array([x[i] for i in known]), np.array([float(labels[i]) for i in known]))
    scores = dict(zip(x, model.score(np.array(list(x.values())))))
    got = quality.op4_quality(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.held_out, r.score, r.predicted) == (held[r.doc_id], scores[r.doc_id], int(scores[r.doc_id] >= 0.5))
