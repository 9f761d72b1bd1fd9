import random
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import suffix_dedup as sd


def by_hand(texts, length):
    """(kept, spans) of each text by counting all strings of the length."""
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        out.append((b"".join(b[i : i + 1] for i in range(len(b)) if not gone[i + 1]), list(zip(edges[::2], edges[1::2]))))
    return out


def check(spark, texts, length, parts=3):
    rows = [(i, t, i, b"x", "y", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tid long, body binary, th string, found int").repartition(parts)
    got = {r.doc_id: r for r in sd.remove_repeats(docs, length).collect()}
    assert len(got) == len(texts)
    for i, (kept, spans) in enumerate(by_hand(texts, length)):
        assert bytes(got[i].kept) == kept, (i, texts[i])
        assert [(s.start, s.stop) for s in got[i].removed] == spans
        assert got[i].th == "y" and got[i].found == 1 and got[i].tid == i
    return got


def random_texts(seed, count, letters, size):
    rng = random.Random(seed)
    passages = ["".join(rng.choices(letters, k=rng.randrange(size))) for _ in range(6)]
    out = [None, "", "x"]
    for _ in range(count):
        out.append("".join(rng.choice([rng.choice(passages), "".join(rng.choices(letters, k=rng.randrange(size)))]) for _ in range(rng.randrange(5))))
    return out + out[3:8]


@pytest.mark.parametrize("length, letters, size", [(16, "ab", 60), (40, "aé\n😀", 90), (47, "abcdefgh", 200)])
def test_random_texts_as_by_hand(spark, length, letters, size, monkeypatch):
    monkeypatch.setattr(sd, "PART", 300)
    texts = random_texts(length, 60, letters, size)
    got = check(spark, texts, length)
    assert any(len(r.removed) > 1 for r in got.values()) and any(not r.removed for r in got.values())


def test_edits_of_long_passages(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefghijklmnop ", k=3000))
    texts = [base, base + "!", "x" * 1200, "xy" * 700, "x" * 399, "=" * 400, "=" * 400]
    for _ in range(12):
        cut = sorted(rng.sample(range(3000), 4))
        texts.append(base[: cut[0]] + "?" + base[cut[1] : cut[2]] + "Ü" * rng.randrange(3) + base[cut[3] :])
    texts += [base[100:499] + "#", "#" + base[100:500], base[700:1300]]
    got = check(spark, texts, 400)
    assert len(got[5].kept) == len(got[6].kept) == 0 and not got[4].removed


def test_runs_that_slices_cut(spark, monkeypatch):
    rng = random.Random(6)
    base = "".join(rng.choices("abcdefg ", k=900))
    for name, value in (("SLICE", 37), ("BLOCK", 500)):
        monkeypatch.setattr(sd, name, value)
    for a, b, c in sd.anchors(memoryview(base.encode()), 60):
        assert all(x <= y for x, y in zip(a, b)) and all(a <= c)
    texts = [base, base[200:], "zz" + base[100:700], base[:50] + base]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in sd.remove_repeats(rows, 60).collect()}
    assert [got[i] for i in range(4)] == [k for k, _ in by_hand(texts, 60)]


def test_suffix_order_is_right():
    """Ranks by one block's levels, as the sort of its suffixes."""
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 99, 2000, dtype=np.uint8)) + bytes(900)
    starts, levels = np.arange(1500, dtype=np.uint32), sd.levels_of(400)
    planned, strings = sd.plan(len(data), starts, levels), [data]
    for level in range(levels):
        shape = planned[level][0]
        keys = sd.Symbols(strings[level], level).triple(shape.position(np.arange(shape.samples)))
        rank = (sd._dense(*keys) + 1).astype(np.uint64)
        strings.append(sd.Symbols.stored(rank))
    for level in reversed(range(levels)):
        shape, asked = planned[level]
        symbols, kind = sd.Symbols(strings[level], level), shape.kind(asked)
        ranked = lambda k: rank[shape.index(asked + k * shape.u)]  # noqa: B023, E731
        order = sd.merged_order(kind, symbols.unit(asked), symbols.unit(asked + shape.u), np.where(kind == 2, ranked(0), ranked(1)), np.where(kind == 1, ranked(0), ranked(2)))
        rank = np.zeros(planned[level - 1][0].samples if level else len(data), np.uint64)
        rank[asked[order]] = np.arange(1, len(order) + 1)
    assert [int(x) for x in asked[order]] == sorted(range(1500), key=lambda i: data[i : i + 900])


def test_empty_table_and_short_strings(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(docs).collect() == []
    with pytest.raises(ValueError):
        sd.remove_repeats(docs, 15)


def test_query_by_brute_force(spark, tmp_path):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefghij \n", k=900))
    texts = [None, "", "short", passage, passage, passage[:450] + " own end", "own start " + passage[300:], "".join(rng.choices("abcdefghij \n", k=2000))]
    spark.createDataFrame([(None if i == 1 else i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    got = sorted(map(repr, map(tuple, sd.op13_suffix_dedup(spark, str(tmp_path)).collect())))
    wanted = [(None if i == 1 else i, len((t or "").encode()), sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, (t, (k, s)) in enumerate(zip(texts, by_hand(texts, 400)))]
    assert got == sorted(map(repr, wanted))
