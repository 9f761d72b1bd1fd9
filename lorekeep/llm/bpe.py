"""BPE encoding and decoding.

Encoding merges a word by a priority queue of merge ranks over a doubly linked list of symbols: the queue holds
rank and position of adjacent pairs in one number, an entry whose symbols have changed since is stale and skipped, and a
merge queues the two pairs it makes.  Decoding concatenates the vocabulary strings of the ids.  Words repeat, so a
worker keeps the ids of the words it has met, within a bound.  Classes, case and composition of characters follow the
installed library, whatever its version of Unicode.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCache, bound_batches, chunks, free_name, table, text_or_empty


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next letter from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0x100
    for b in range(256):
        letters.append(chr(b if b in printable else spare))
        spare += b not in printable
    return letters


#: White space in patterns.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: From here on characters may compose, be reordered or have case rules of their own.
_BEYOND_LATIN = re.compile("[\u0300-\U0010ffff]")
#: Texts of these signs alone hold no special string, are changed by the normalizers ``_USUAL`` in case and white space only, and are split by ``_WORDS`` thus.
_PLAIN_TEXT, _PLAIN_WORDS = re.compile(r"""[A-Za-zÀ-ÖØ-öø-ÿ.,;:!?#$%&()*/"\n -]*"""), re.compile(r"""[a-zß-öø-ÿ]+|[.,;:!?#$%&()*/"-]+""")
_USUAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(1)
def newer_characters() -> tuple[frozenset[str], frozenset[str], dict[int, str]]:
    """Letters, digits and small letters that the installed library knows and Python's Unicode does not have yet."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    unknown = " ".join(chr(c) for c in range(0x40000) if unicodedata.category(chr(c)) == "Cn")
    letters, digits = (frozenset(w for w, _ in pre_tokenizers.Split(Regex(p), "removed", invert=True).pre_tokenize_str(unknown)) for p in (r"\p{L}", r"\p{N}"))
    lower = normalizers.Lowercase()
    small = {ord(c): s for c in unknown.split() if (s := lower.normalize_str(c)) != c}
    return letters, digits, small


def class_ranges(category: str, more: frozenset[str]) -> str:
    """The inside of a character class of all code points of a general category, and ``more``."""
    out, start = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and (unicodedata.category(chr(c))[0] == category or chr(c) in more)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append((start, c - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class BPE:
    """The encoder and decoder of a vocabulary file of the kind of word_bpe_49k.json."""

    def __init__(self, path: str, cache: int = 400_000, chunk_cache: int = 200_000):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        # a pair of symbol ids is one number, first * base + second: pair -> rank, and by rank the pair and the id of what it makes
        self.base = max(self.vocab.values()) + 1
        self.pairs = [self.vocab[a] * self.base + self.vocab[b] for a, b in model["merges"]]
        self.made = [self.vocab[a + b] for a, b in model["merges"]]
        self.merges: dict[int, int] = {pair: rank for rank, pair in enumerate(self.pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = byte_letters()
        self.first = [self.vocab.get(c) for c in self.letters]
        self.last = [self.vocab.get(c + self.suffix) for c in self.letters]
        self.steps = [self._step(n) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        pattern = splits[0]["pattern"]["Regex"]
        self.plain = pattern == _WORDS and (spec["normalizer"] or {}).get("normalizers") == _USUAL
        self.latin_pattern = regex.compile(pattern)  # the same for characters up to U+00FF, and faster
        letters, digits, _ = newer_characters()
        for name, inside in ((r"\p{L}", class_ranges("L", letters)), (r"\p{N}", class_ranges("N", digits)), (r"\s", SPACES)):
            pattern = pattern.replace(name, inside)
        self.pattern = re.compile(pattern)
        self.strings: dict[int, str] = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.words = WordCache(self._encoded_word, cache)
        self.chunks = WordCache(self._encoded_chunk, chunk_cache)

    @staticmethod
    def _step(spec: dict):
        if spec["type"] == "NFC":
            from tokenizers import normalizers

            # the library's order and composition of marks, which may be newer than Python's
            compose = normalizers.NFC().normalize_str
            return lambda t: t if t.isascii() or not _BEYOND_LATIN.search(t) else compose(t)
        if spec["type"] == "Lowercase":
            small = newer_characters()[2]
            # a capital sigma is letter by letter: no rule of final letters
            return lambda t: (t if t.isascii() else t.translate(small)).lower() if "Σ" not in t else "".join(c.lower() for c in t.translate(small))
        if spec["type"] == "Replace":
            pattern, content = regex.compile(spec["pattern"]["Regex"]), spec["content"]
            return lambda t: pattern.sub(content, t)
        raise ValueError(f"unknown normalizer {spec['type']}")

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        symbols = [i for b in word[:-1] if (i := self.first[b]) is not None]
        if (end := self.last[word[-1]]) is not None:
            symbols.append(end)
        n, base, rank_of, pairs = len(symbols), self.base, self.merges.get, self.pairs
        queue = [rank * n + i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := rank_of(a * base + b)) is not None]
        if not queue:
            return symbols
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heapify(queue)
        while queue:
            rank, i = divmod(heappop(queue), n)
            j = after[i]
            if j < 0 or symbols[i] * base + symbols[j] != pairs[rank]:
                continue  # stale: one of the two has been merged away
            symbols[i] = made = self.made[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := rank_of(made * base + symbols[k])) is not None:
                    heappush(queue, rank * n + i)
            if (h := before[i]) >= 0 and (rank := rank_of(symbols[h] * base + made)) is not None:
                heappush(queue, rank * n + h)
        return [s for s in symbols if s >= 0]

    def _encoded_word(self, word: str) -> str:
        return " ".join(map(str, self.merge(word.encode("utf-8"))))

    def _encoded_chunk(self, text: str) -> str:
        """The decimal ids of a text, joined by one space."""
        if self.plain and _PLAIN_TEXT.fullmatch(text):
            return " ".join([ids for word in _PLAIN_WORDS.findall(text.lower()) if (ids := self.words[word])])
        spans, at = [], 0
        if self.special_pattern and "<" in text:
            for m in self.special_pattern.finditer(text):
                spans += [(text[at : m.start()], None), ("", self.special[m[0]])]
                at = m.end()
        spans.append((text[at:], None))
        out: list[str] = []
        for part, special in spans:
            if special is not None:
                out.append(str(special))
            elif part:
                for step in self.steps:
                    part = step(part)
                out += [ids for word in self.split(part) if (ids := self.words[word])]
        return " ".join(out)

    def encode_text(self, text: str) -> str:
        """As ``_encoded_chunk``, by parts that no merge reaches across and that mostly are known."""
        return " ".join([ids for ids in map(self.chunks.__getitem__, chunks(text)) if ids])

    def split(self, text: str) -> list[str]:
        """The words of a normalized text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.latin_pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_text(text).split()]

    def decode(self, ids) -> str:
        """The vocabulary strings of ``ids``, concatenated as the library does without a decoder: with one space between."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


_loaded: dict[str, BPE] = {}


def load(path: str) -> BPE:
    """One encoder a worker and path."""
    if path not in _loaded:
        _loaded[path] = BPE(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` without ``text``, with n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if ``with_ids``).

    Null texts count as empty: no tokens, digests of the empty string.  No token is added or cut; special strings in
    a text become their tokens.  Existing columns of these names are replaced; repeated rows are encoded each.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    bound_batches(docs.sparkSession)
    kept = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else []))
    body = free_name(kept, "body")
    rows = kept.withColumn(body, text_or_empty(text)).drop(text)
    schema = rows.drop(body).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches):
        bpe = load(path)
        strings = {str(i): s for i, s in bpe.strings.items()}
        digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value in batch.column(body):
                joined = bpe.encode_text(value.as_py())
                ids = joined.split()
                decoded = " ".join(map(strings.__getitem__, ids))
                row = (len(ids), digest(joined), digest(decoded), [int(i) for i in ids] if with_ids else None, decoded)
                for column, x in zip(out, row[: 5 if with_ids else 3]):
                    column.append(x)
            keep = [i for i, n in enumerate(batch.schema.names) if n != body]
            types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(c, t) for c, t in list(zip(out, types))[: 5 if with_ids else 3])], names=schema.names)

    return rows.mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
