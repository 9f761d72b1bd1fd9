import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorekeep.llm import bpe, token_count

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTERS = [token_count.counter_of(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.json") if token_count.may_be_cut(name)]
ODD = ["", "  ", "<|endoftext|>x <|startoftext|><|endoftext|", "İstanbul ΣΑΣ ΟΔΟΣ", "naïve café 日本語 😀", "it's I'LL we've 'd '''s", "a\x00b\x1c\x85 c", "é K Å ß ẞ", "x" * 3000, "١٢٣ 12 ½", "_a_b"]


@pytest.mark.parametrize("text", ODD)
def test_encode_as_the_library(text):
    wanted = LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.load(PATH).encode(text) == wanted
    assert bpe.load(PATH).decode(wanted) == LIBRARY.decode(wanted, skip_special_tokens=False)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_encode_any_text_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    assert bpe.load(PATH).encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_op9_columns(spark, docs_of):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(99, None, "s"), (0, "a", "s"), (0, "a", "s")]
    got = bpe.encode_decode(docs_of(rows), with_ids=True).collect()
    assert len(got) == len(rows)
    for (i, t, _), r in zip(rows, got):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.ids, r.n_tokens) == (i, ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(docs_of(rows).limit(0)).collect() == []


@pytest.mark.parametrize("limit", [5, 60, 4000])
def test_pieces_count_like_the_whole(limit):
    text = " ".join(ODD) + "\nabc def " * 50
    count = token_count.counter_of("word_bpe_49k.json")
    parts = token_count.pieces(text.encode(), limit)
    assert b"".join(parts) == text.encode()
    assert sum(count([p.decode() for p in parts])) == count([text])[0]


def test_count_tokens(spark, docs_of):
    rows = [(i, t, "s") for i, t in enumerate([*ODD, "word " * 40_000])] + [(None, None, "s")]
    got = token_count.count_tokens(docs_of(rows)).collect()
    for (i, t, _), r in zip(rows, got):
        n = len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (i, len((t or "").encode()), n, n > 2048)
    assert token_count.count_tokens(docs_of(rows).limit(0)).collect() == []
    pieces = token_count.count_tokens(docs_of(rows), "piece_bpe_32k.model").collect()
    assert pieces[4].n_tokens > 0 and pieces[0].n_tokens == 0


def test_every_code_point_as_the_library():
    ours = bpe.load(PATH)
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x3_0000), *range(0xE_0000, 0xE_0200))]
    texts = ["".join(f"{c}a {c} ́{c}́b{c}̣́ " for c in points[i : i + 16]) for i in range(0, len(points), 16)]
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        for text, wanted in zip(part, LIBRARY.encode_batch(part, add_special_tokens=False)):
            assert ours.encode(text) == wanted.ids, text.encode("unicode_escape")


@given(st.lists(st.sampled_from([" ", "  ", "́", " ", "\x85", "\n", "<|endoftext|>", "a", "é", ".", "'s", "日", "。", "​", "<|", "7", "Σ", "が"]), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_parts_count_like_the_whole(text):
    for count in COUNTERS:
        assert token_count.PartCounts(count, False).of([text.encode()] * 2) == count([text]) * 2
    assert bpe.load(PATH).encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_without_blanks_are_cut_too(name):
    count = token_count.counter_of(name)
    text = "".join(f"日本語の文章{i}番目、「これは」テスト。한국어도，中文也是！（そうです）" for i in range(400))
    parts = token_count.pieces(text.encode(), 300)
    assert len(parts) > 80 and b"".join(parts) == text.encode()
    assert sum(count([p.decode() for p in parts])) == count([text])[0]


def test_tokenizers_that_mark_a_start_stay_whole(tmp_path):
    import json

    assert not token_count.may_be_cut("piece_bpe_32k.model")
    spec = json.load(open(PATH))
    for change in ({"normalizer": {"type": "Prepend", "prepend": "x"}}, {"pre_tokenizer": {"type": "Metaspace"}}, {"added_tokens": [dict(spec["added_tokens"][0], rstrip=True)]}):
        path = tmp_path / "changed.json"
        path.write_text(json.dumps(spec | change))
        assert not token_count.may_be_cut("changed.json", str(path))


def test_what_is_known_is_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "KNOWN_PARTS", 20)
    texts = [f"say word{i % 50} again, {'long' * 100}{i % 3} end." for i in range(200)]
    counts = token_count.PartCounts(COUNTERS[0], False)
    assert [n for t in texts for n in counts.of([t.encode()])] == COUNTERS[0](texts)
    assert len(counts.following) <= 40 and max(map(len, counts.following.old)) <= 256


@pytest.mark.parametrize("text", ["x İ.", "x İ,", "a İ! İİ? é. ß: İ.", "x i̇. ٣. x"])
def test_marks_after_letters_that_end_in_a_mark(text):
    from lorekeep.llm import token_count as tc

    count = tc.counter_of("word_bpe_49k.json")
    assert tc.PartCounts(count, False).of([text.encode()]) == count([text])


def test_plain_texts_and_many_words_are_merged_once():
    encoder, rng, merged = bpe.BPE(PATH), random.Random(5), []
    for signs in ("abcAB.,!?\n  :;-\"#", "éÉßÿÀÖØ×÷ùÞþª² aB.\n", "".join(map(chr, range(256))), "it's <|x"):
        for _ in range(2000):
            text = "".join(rng.choices(signs, k=rng.randrange(30)))
            assert encoder.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    encoder.words.make = lambda word: merged.append(word) or "1"
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(f"q{i}".translate(letters) for i in range(k, k + 1000)) for k in range(100_000, 350_000, 1000)]
    for _ in range(2):
        for text in texts:
            encoder.encode_text(text)
    assert len(merged) == 250_000  # more words than one generation of chunks holds
