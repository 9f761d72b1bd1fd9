import hashlib
import re

import pytest

from lorekeep.llm import infill as fim


def by_hand(i, t, seed=7):
    """(n, form, prefix, middle, output) with lists of units and slices."""
    t = t or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(fim.LINES, t)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or "<P>" in t or "<S>" in t or "<M>" in t:
        return len(units), "plain", None, None, t
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [None, "", "\n", "\n\n\n", "one", "one\ntwo", "a\n\nb\n", "é😀\nü\n\n😀", "has <P>\nmark", "<M>", "<S", "<\nP>\n<", " \r\n\x0b\x85 x\n", "x" * 1_000_000, "\n" * 200_000, "line\n" * 50_000 + "<P"]


def test_texts_as_by_hand(spark, docs_of):
    rows = [(i, t, "s") for i in [*range(12), None, -5] for t in TEXTS]
    got = fim.restore(fim.transform(docs_of(rows)))
    assert got.columns[:6] == ["doc_id", "text", "source", "size", "h", "node"]
    found = got.collect()
    assert len(found) == len(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[1] is None)
    assert sorted(((r.doc_id, r.text, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.infilled) for r in found), key=key) == sorted(((i, t, *by_hand(i, t)) for i, t, _ in rows), key=key)
    assert all(r.restored == (r.text or "") and r.node == "node?" for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a\nb\n", "x", 5, "y")], "doc_id long, text string, form string, body int, name string")
    assert fim.transform(df.limit(0)).collect() == []
    r = fim.transform(df).first()
    assert r.form in ("psm", "spm") and r.body == 5 and r.name == "y" and r.n_units == 2


def test_rates_marks_and_units(spark):
    df = spark.createDataFrame([(i, f"w{i} x y z " * 3) for i in range(400)], "doc_id long, text string")
    words = fim.Infill(seed=3, rate=50, spm_rate=0, prefix="[pre]", suffix="[suf]", middle="[mid]", unit=r"\S+\s*")
    got = fim.restore(fim.transform(df, words), words).collect()
    assert {r.form for r in got} == {"plain", "psm"} and 140 < sum(r.form == "plain" for r in got) < 260
    assert all(r.restored == r.text and r.n_units == 12 for r in got)
    with pytest.raises(ValueError):
        fim.Infill(prefix="<P>", suffix="<P>x")
    with pytest.raises(ValueError):
        fim.Infill(unit=r"\s*")
    with pytest.raises(ValueError):
        fim.Infill(rate=101)


def test_marks_that_straddle_a_cut_stay_plain():
    how = fim.Infill(prefix="aPa", suffix="aSa", middle="aMa", unit=".")
    unit = re.compile(".")
    for text in ("xaS", "aSxaP", "aMaM"[:3] + "b", "aaaa"):
        for k in range(50):
            _, form, _, _, out = fim.infill(text, k, how, unit)
            assert fim.rebuild(out, form, how) == text
