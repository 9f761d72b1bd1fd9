import random
import re
from collections import Counter

from lorekeep.llm import collocations as co


def by_hand(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    inside = {(lang, p[i:j]) for (lang, p), x in out.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and x[1] >= f[lang, p[i:j]]}
    ranked = []
    for lang in {x for x, _ in out}:
        best = sorted(((-s, -a, " ".join(p).encode(), l, r) for (g, p), (s, a, l, r) in out.items() if g == lang and (g, p) not in inside))[:top]
        ranked += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(best)]
    return sorted(ranked)


def some_texts(seed, count):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "été", "\x85x", "\x00", "ÿ", "a b", "😀", "İ"]
    rows = [(None, None), ("en", None), ("en", ""), ("en", " \t ,;"), (None, "a b " * 30)]
    for _ in range(count):
        words = rng.choices(vocabulary, k=rng.randrange(40))
        if rng.random() < 0.5:
            words[3:3] = ["New", "York", "City", "Hall", "Now", "end"][: rng.randrange(7)]
        rows.append((rng.choice(["en", "en", "de", "", None]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b"]) for w in words)))
    return rows + rows[:20]


def test_phrases_as_by_hand(spark):
    rows = some_texts(1, 300)
    docs = spark.createDataFrame([(lang, t, 1, "x", "y") for lang, t in rows], "lang string, text string, blk int, words string, f string").repartition(5)
    for least, top in ((4, 2000), (12, 7)):
        got = co.collocations(docs, least=least, top=top).collect()
        wanted = by_hand(rows, least, top=top)
        assert len(wanted) > 10 and sorted(map(tuple, got)) == wanted


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = some_texts(2, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    wanted = by_hand(rows, 5)
    assert sorted(map(tuple, co.collocations(docs, least=5).collect())) == wanted
    text = co._PLAIN  # slices of every size join to the same pieces
    for _, t in rows:
        body = (t or "").encode().translate(text)
        assert b"\xff".join(co.slices(body, 3)) == body


def test_long_texts_and_empty_tables(spark):
    rows = [("en", "one two three four five six " * 60_000), ("en", "x" * 500_000 + " y"), ("de", "eins zwei. " * 300)]
    got = {(r.lang, r.phrase): r for r in co.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()}
    assert got["de", "eins zwei"].a == 300 and got["en", "one two three four five"].a == 60_000
    docs = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(docs).collect() == []


def test_products_beyond_64_bits(spark):
    rows = [("en", "aa bb " * 40_000 + ". " + "cc dd " * 3_000)]
    got = [tuple(r) for r in co.collocations(spark.createDataFrame(rows, "lang string, text string"), longest=3).collect()]
    assert sorted(got) == by_hand(rows, 100, 3)


def test_many_small_ranges_count_the_same(spark):
    rows = some_texts(3, 200)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    f = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            f.update(("und" if lang is None else lang, " ".join(w[i : i + k])) for k in range(1, 4) for i in range(len(w) - k + 1))
    wanted = sorted((lang, p, p.count(" ") + 1, n) for (lang, p), n in f.items() if n >= 6)
    for range_words in (1, 50, 10**9):
        got, _ = co.frequent_phrases(docs, 6, 3, range_words=range_words)
        assert sorted(map(tuple, got.collect())) == wanted


def test_words_and_lists_travel_packed(spark, monkeypatch):
    plans, written = {}, co.materialize

    def seen(df, name, *codec):
        plans[name] = (df._jdf.queryExecution().optimizedPlan().toString(), df.columns)
        return written(df, name, *codec)

    monkeypatch.setattr(co, "materialize", seen)
    docs = spark.createDataFrame(some_texts(4, 60), "lang string, text string")
    co.frequent_phrases(docs, 4, 3)
    # no word of a block is a row that is joined, and no list of words goes along with those of phrases
    assert all("Join Inner, ((lang" not in plan for plan, _ in plans.values())
    assert plans["lists-1"][1] == plans["lists-2"][1] == ["blk", "ids", "lasts", "sizes", "at"]
