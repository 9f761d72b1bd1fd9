from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import mixing

WEIGHTS = (5, 2, 1)


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = 1.0, max_epochs: int = 3) -> dict[str | None, float]:
    """Targets by weight; a target stops at ``max_epochs`` times its source, and the excess is shared anew by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = Fraction(share) * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > max_epochs * sizes[s]]
        if not over:
            return out | {s: float(left * weight[s] / total) for s in open_}
        for s in over:
            out[s] = float(max_epochs * sizes[s])
        left -= sum(max_epochs * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 6)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 400))
@settings(max_examples=200, deadline=None)
def test_fit_is_the_best_sum_from_below(histogram, budget):
    lengths, counts = map(np.array, zip(*histogram))
    total = int((lengths * counts).sum())
    take = mixing.fit_counts(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    got = int((lengths * take).sum())
    if budget >= total:
        assert got == total
        return
    # the proportional share comes first, so the best is over what it leaves
    base = np.array([0 if l == 0 else int(c) * budget // total for l, c in zip(lengths, counts)])
    sums = {int((lengths * base).sum())}
    for l, c, b in zip(lengths, counts, base):
        sums = {s + int(l) * k for s in sums for k in range(int(c - b) + 1)}
    assert got == max(s for s in sums if s <= budget)


def test_targets_share_by_weight_and_stop_at_three_times():
    sizes = {"a": 10, "b": 1000, None: 1000}
    got = source_targets(sizes)
    assert got["a"] == 30.0
    assert got["b"] + got[None] == pytest.approx(1980.0)
    assert got["b"] / got[None] == pytest.approx(2.0)
    assert source_targets({}) == {}
    assert source_targets({"x": 0, "y": 4}) == {"x": 0.0, "y": 4.0}


def test_mix_meets_targets(spark, docs_of):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), "abc"[i % 3] if i % 7 else None) for i in range(4000)]
    rows += [(5, None, "a"), (6, "", "a"), (7, "x", "a"), (7, "x", "a"), (None, "y z", "b")]
    docs = docs_of(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        n = len([w for w in (r.text or "").split(" ") if w])
        assert r["size"] == n and r.taken % max(n, 1) == 0 and r.taken <= 3 * n
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        assert rs[0].source_size == sum(r["size"] for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 1
    again = {(r.doc_id, r.text, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text, r.taken) for r in got}
    assert mixing.mix(docs.limit(0)).collect() == []


def test_mixed_rows_repeat_what_is_taken(spark, docs_of):
    docs = docs_of([(1, "a b", "s"), (2, "c", "t"), (3, "d e f g h i j k", "t")])
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    counts: dict = {}
    for r in rows.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"https://s{i}.example/ü": int(rng.integers(0, 10 ** int(rng.integers(1, 12)))) for i in range(300)} | {"": 7, "ß\U0001F600": 3, "\uffff": 5, None: 11}
    hist = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "s string, l long, n long")
    got = {r.s: r.target for r in mixing.with_targets(mixing.source_weights(hist)).collect()}
    assert got == source_targets(sizes)
    small = hist.filter("n < 0")
    assert mixing.with_targets(mixing.source_weights(small)).collect() == []


def test_the_whole_query_equals_brute_force(spark, tmp_path):
    """Sizes, targets and the choice by seeded order, all over again in plain Python."""
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 50 == 0 else " ".join(["w\u00a0w"] * int(rng.integers(0, 40))) + "\n", ["a", "b", "c", None][int(rng.integers(0, 4)) if i > 300 else 0]) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in mixing.op1_mixing(spark, str(tmp_path)).collect()}
    words = {i: len([w for w in (t or "").replace("\n", " ").split(" ") if w]) for i, t, _ in rows}
    sizes: dict = {}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words[i]
    targets = source_targets(sizes)
    order = {r.i: r.h for r in spark.range(900).selectExpr("id AS i", "xxhash64(17, id) AS h").collect()}
    for source, size in sizes.items():
        mine = [i for i, _, s in rows if s == source]
        goal = round(targets[source])
        lengths = sorted({words[i] for i in mine})
        extra = mixing.fit_counts(np.array(lengths), np.array([sum(words[i] == n for i in mine) for n in lengths]), goal - goal // size * size)
        taken = {i: goal // size * words[i] for i in mine}
        for n, x in zip(lengths, extra):
            for i in sorted((i for i in mine if words[i] == n), key=order.get)[:x]:
                taken[i] += n
        for i in mine:
            r = got[i]
            assert (r["size"], r.source_size, r.target, r.taken) == (words[i], size, targets[source], taken[i])
