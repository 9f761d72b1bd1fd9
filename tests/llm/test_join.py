import random

import numpy as np
import pytest

from lorekeep.llm import ngram_join as nj


def words_of(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]


def brute(rows, n, percent):
    sets = []
    for i, t, _ in rows:
        w = words_of(t)
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[j : j + n]) for j in range(len(w) - n + 1)})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least: dict = {}
    for a, (i, _, _) in enumerate(rows):
        r = find(a)
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(sets[a]), least[find(a)]) for a, (i, _, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocab, k=40))
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            t = rng.choice(texts[-30:]).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            t = " ".join(t)
        else:
            t = " ".join(rng.choices(vocab, k=rng.choice([3, 9, 60, 200])))
            if rng.random() < 0.3:
                t += "\n" + passage
        texts.append(t)
        rows.append((i, t if rng.random() < 0.9 else t.upper() + " ", "s"))
    return rows


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 50, 3)])
def test_components_are_those_of_brute_force(spark, docs_of, monkeypatch, n, percent, seed):
    monkeypatch.setattr(nj, "POSTING_ROWS", 8)
    rows = corpus(seed, 260) + [(900, None, "s"), (901, "", "s"), (902, " \n", "s"), (903, "one", "s"), (904, "ONE", "s"), (905, "one two", "s"), (7, "w1 w2 w3 repeated row", "s"), (7, "w1 w2 w3 repeated row", "s")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.join_components(docs_of(rows), n, percent).collect())
    assert got == brute(rows, n, percent)


def test_empty_table_and_one_row(spark, docs_of):
    docs = docs_of([(4, "a b c d", "s")])
    assert nj.join_components(docs.limit(0), 3, 90).collect() == []
    assert [tuple(r) for r in nj.join_components(docs, 3, 90).collect()] == [(4, 2, 4)]


def test_keep_one(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(100))
    docs = docs_of([(3, text, "s"), (1, text + " more", "s"), (2, "other", "s"), (5, "", "s"), (6, None, "s"), (2, "other", "s")])
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]


def test_keep_one_keeps_a_row_of_each_group(spark, docs_of):
    text = {c: " ".join(f"{c}{i}" for i in range(100)) for c in "abcd"}
    rows = [(5, text["a"], "s"), (5, text["b"] + " more", "s"), (3, text["b"], "s")]  # one id with texts of two groups
    rows += [(None, text["c"], "s"), (None, text["c"] + " more", "s"), (None, text["d"], "s"), (9, text["d"] + " more", "s")]
    rows += [(None, "", "s"), (None, None, "s"), (7, " ", "s"), (7, " ", "s"), (7, "x y z", "s")]
    kept = nj.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    got = sorted(((r.doc_id, (r.text or "").split(" ")[0]) for r in kept.collect()), key=str)
    assert got == sorted([(5, "a0"), (3, "b0"), (None, "c0"), (9, "d0"), (None, ""), (None, ""), (7, ""), (7, "x")], key=str)


def test_prefixes_share_what_they_must():
    rng = np.random.default_rng(5)
    heavy = np.sort(rng.integers(0, 2**64, 50, np.uint64))
    counts = rng.integers(4, 900, 50)
    for _ in range(200):
        n = int(rng.integers(2, 120))
        base = np.unique(np.concatenate([rng.integers(0, 2**64, n, np.uint64), rng.choice(heavy, 5)]))
        other = np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], rng.integers(0, 2**64, 2, np.uint64)]))
        common = len(np.intersect1d(base, other))
        if 100 * common < 80 * (len(base) + len(other) - common):
            continue
        (p, _, l), (q, _, m) = (nj.choose_prefix(s, 80, heavy, counts) for s in (base, other))
        assert len(np.intersect1d(p, q)) >= min(l, m)
        assert nj.least_difference(nj.parity_bits(base), nj.parity_bits(other)) <= len(base) + len(other) - 2 * common


def test_word_hashes_are_of_words():
    a = nj.word_hashes(b"The cat\tTHE  \x0bdog cat")
    assert a[0] == a[2] and a[1] == a[4] and len(set(a.tolist())) == 3
    assert nj.word_hashes("é É".encode())[0] != nj.word_hashes("é É".encode())[1]
    long = b"x " * 200_000
    assert len(set(nj.word_hashes(long).tolist())) == 1


def test_very_long_texts_and_one_huge_group(spark, docs_of, monkeypatch):
    monkeypatch.setattr(nj, "POSTING_ROWS", 64)
    monkeypatch.setattr(nj, "FOUND_ROWS", 500)
    long = [f"w{i * i % 100_003}" for i in range(200_000)]
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base), "s") for i in range(1500)]  # equal texts
    rows += [(2000 + i, " ".join([*base[:30], f"n{i}", *base[30:]]), "s") for i in range(700)]  # near copies, each with a word of its own
    rows += [(5000, " ".join(long), "s"), (4999, " ".join([*long, "more"]), "s"), (5001, "y" * 1_000_000, "s")]
    got = {r.doc_id: r for r in nj.join_components(docs_of(rows), 3, 90).collect()}
    assert len(got) == len(rows)
    assert {r.component_id for i, r in got.items() if i < 4000} == {0}
    assert got[5000].component_id == 4999 and got[5001].component_id == 5001 and got[5001].n_shingles == 1
    assert got[5000].n_shingles == len({tuple(long[i : i + 3]) for i in range(len(long) - 2)})


def test_words_that_collide_as_polynomials_stay_apart(spark, docs_of):
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r.component_id for r in nj.join_components(docs_of([(1, thue, "s"), (2, other, "s"), (3, thue.upper(), "s")]), 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    words = [thue, other, "a" * 8, "a" * 9, "a" * 7 + "\0", "a" * 7, "b" * 8 + "a" * 8, "a" * 8 + "b" * 8]
    assert len(set(nj.word_hashes(" ".join(words).encode()).tolist())) == len(words)


def test_near_copies_below_the_threshold_are_no_pairs(spark, docs_of, monkeypatch):
    """Sets that nearly link with all others of a group leave the searches as rows of their own, not as pairs."""
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:90], *(f"own{i}.{j}" for j in range(18)), *base[108:]]), "s") for i in range(120)]  # 174 of 218 shingles are common
    made, write = {}, nj.materialize

    def counted(df, name, codec=None):
        table = write(df, name, codec)
        made[name] = max(made.get(name, 0), table.count())
        return table

    monkeypatch.setattr(nj, "materialize", counted)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.join_components(docs_of(rows), 5, 80).collect())
    assert got == brute(rows, 5, 80) and len({c for _, _, c in got}) == len(rows)
    assert {k: v for k, v in made.items() if k.startswith("join-") and k not in ("join-posted", "join-lists", "join-left") and v > 2 * len(rows)} == {}


def counted_tables(monkeypatch):
    made, write = {}, nj.materialize

    def counted(df, name, codec=None):
        table = write(df, name, codec)
        made.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(nj, "materialize", counted)
    return made


def test_lists_of_sets_of_other_sizes_are_not_searched(spark, docs_of, monkeypatch):
    made = counted_tables(monkeypatch)
    rows = [(i, " ".join(f"b{j}" for j in range(int(20 * 1.25**i))), "s") for i in range(14)]  # each set holds all before
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.join_components(docs_of(rows), 3, 90).collect())
    assert got == brute(rows, 3, 90) and made["join-posted"][0] > 100 and made["join-lists"] == [0]


def test_large_sets_are_told_apart_by_whole_parity_bits(spark, docs_of, monkeypatch):
    made = counted_tables(monkeypatch)
    half = lambda x: [f"{x}{j}" for j in range(3000)]
    rows = [(1, " ".join([*half("a"), *half("b")]), "s"), (2, " ".join([*half("a"), *half("c")]), "s"), (3, " ".join([*half("d"), *half("e")]), "s"), (4, " ".join([*half("d"), *half("e"), "f"]), "s")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in nj.join_components(docs_of(rows), 3, 90).collect())
    assert got == brute(rows, 3, 90) and made["join-lists"][0] > 0 and made["join-open"] == [0]
