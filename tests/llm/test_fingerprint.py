import hashlib

import xxhash
from pyspark.sql import functions as F

from lorekeep.llm import fingerprint as fp


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def sketch(text, k=fp.K, width=fp.WIDTH):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate(dict.fromkeys(range(9, 14), " ")).split(" ") if x]
    s = [] if not w else [" ".join(w)] if len(w) <= width else [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]
    return sorted({signed(xxhash.xxh64_intdigest(x.encode(), seed=42)) for x in s})[:k]


def hexed(s):
    return "".join(f"{x % 2**64:016X}" for x in s)


def likeness(a, b, k=fp.K):
    both = sorted({*a, *b})[:k]
    return 1.0 if not a and not b else len({*both} & {*a} & {*b}) / max(1, len(both))


def test_edited_pairs_as_brute_force(spark, docs_of):
    rows = [(i * 3 % 50, " ".join(f"Wört{j * i % 37}" for j in range(i * 7)) + "\n" * (i % 3), "s") for i in range(50)]
    rows += [(200, None, "s"), (201, "", "s"), (202, "😀 x", "s"), (3, "same id", "s"), (None, "no id", "s"), (None, None, "s"), (202, "😀 x", "s")]
    got = fp.edited_pairs(docs_of(rows)).collect()
    row = lambda i, t: (-(2**63) if i is None else i, signed(xxhash.xxh64_intdigest((t or "").encode(), seed=42)), t or "")
    order = sorted({row(i, t) for i, t, _ in rows}, reverse=True)
    after = {r: order[(j + 1) % len(order)] for j, r in enumerate(order)}
    wanted = []
    for i, t, _ in rows:
        t, nxt = t or "", after[row(i, t)][2]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = sketch(t), sketch(edited), sketch(nxt)
        wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), likeness(a, b), likeness(a, c)))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got), key=key) == sorted(wanted, key=key)


def test_empty_and_single(spark, docs_of):
    docs = docs_of([(1, "a b c", "s")])
    assert fp.edited_pairs(docs.limit(0)).collect() == []
    r = fp.edited_pairs(docs).first()
    assert r.near_next == 1.0 and r.n_chars == 5 and r.edited_sha256 == hashlib.sha256(b"a ba ").hexdigest()


def test_estimates(spark):
    a = " ".join(f"w{i}" for i in range(3000))
    b = " ".join(f"w{i}" for i in range(1000, 5000))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    r = df.select(fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.containment(F.col("a"), F.col("b")).alias("c"), fp.distinct_count(F.col("a")).alias("n")).first()
    assert abs(r.r - 1996 / 4996) < 0.15 and abs(r.c - 1996 / 2996) < 0.25 and abs(r.n - 2996) < 900


def test_parts_merge_to_the_whole(spark):
    rows = [(i % 3, f"w{i} x{i} y{i} z{i} u{i} v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "g int, t string").withColumn("s", fp.sketch(F.col("t")))
    got = {r.g: r.s for r in fp.merge_all(df, ["g"], "s").collect()}
    for g in range(3):
        assert got[g] == sorted({h for k, t in rows if k == g for h in sketch(t)})[: fp.K]


def test_very_long_texts_and_one_huge_group(spark, docs_of):
    long = " ".join(f"w{i * i % 100_003}" for i in range(300_000))
    rows = [(7, "one row of many copies, six words", "s")] * 3000 + [(8, long, "s"), (9, "x" * 1_000_000, "s"), *((100 + i, "one text of many ids, and no more", "s") for i in range(1500))]
    got = fp.edited_pairs(docs_of(rows)).select("doc_id", "n_chars", "fingerprint").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[8].fingerprint == hexed(sketch(long)) and by[9].n_chars == 1_000_000
    assert len({r.fingerprint for r in got if r.doc_id == 7}) == 1 and len({r.fingerprint for r in got if r.doc_id >= 100}) == 1
