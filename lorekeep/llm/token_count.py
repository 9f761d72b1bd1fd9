"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, where no token, normalisation or special string of the tokenizer can reach across:
long ones into pieces of about ``PIECE_BYTES``, and those at blanks.  What is not known yet of a batch of about
``BATCH_BYTES`` bytes is encoded in one call, each distinct part once, and the lengths are added up.
"""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG_WORD, bound_batches, chunks, free_name, table, text_or_empty

BATCH_BYTES, PIECE_BYTES = 1 << 20, 1 << 16
#: Parts whose counts a worker keeps at most, in each of two generations.
KNOWN_PARTS = 300_000
#: Marks that no tokenizer of words joins to the ASCII letter or digit before them, if a blank or nothing follows (others may end in a combining mark once they are normalised).
MARKS = frozenset(",.;:!?")
#: Where a long text is cut: before a blank or line feed after an ASCII letter or digit, and in texts without blanks before
#: a full-width stop, comma, bracket or the like after a kana, an ideograph or a Hangul syllable.  The sign opens the next piece.
BOUNDARY = re.compile(
    rb"(?<=[0-9A-Za-z])[ \n]"
    rb"|(?:(?<=\xe3\x81[\x81-\xbf])|(?<=\xe3\x82[\x80-\x96\xa1-\xbf])|(?<=\xe3\x83[\x80-\xba])|(?<=[\xe5-\xe9][\x80-\xbf][\x80-\xbf])|(?<=[\xeb\xec][\x80-\xbf][\x80-\xbf]))"
    rb"(?:\xe3\x80[\x81\x82\x8c-\x8f]|\xef\xbc[\x81\x88\x89\x8c\x9a\x9b\x9f])"
)


def pieces(text: bytes, limit: int = PIECE_BYTES) -> list[bytes]:
    """``text`` cut at safe boundaries into pieces of about ``limit`` bytes; uncut where it has no boundary."""
    out, start = [], 0
    while len(text) - start > limit:
        cut = BOUNDARY.search(text, start + limit)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def may_be_cut(name: str, path: str | None = None) -> bool:
    """Whether the tokenizer counts pieces like the whole.

    Not if it marks a text's start (sentencepiece, Metaspace, a prefixed blank), if its special strings hold or swallow
    blanks, or if it normalises in a way that is not known here.  The patterns that it splits by are taken not to reach
    over a boundary, as a split into words does not.
    """
    if name.endswith(".model"):
        return False
    spec = json.load(open(_path(name, path), encoding="utf-8"))

    def parts(x, inner: str) -> list[dict]:
        return [] if x is None else [y for part in x[inner] for y in parts(part, inner)] if x["type"] == "Sequence" else [x]

    before = parts(spec["normalizer"], "normalizers")
    splits = parts(spec["pre_tokenizer"], "pretokenizers")
    return (
        bool(splits)
        and all(n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in before)
        and all(p["type"] == "Split" or p["type"] == "ByteLevel" and not p["add_prefix_space"] for p in splits)
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in spec["added_tokens"])
    )


def _path(name: str, path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return path


def counter_of(name: str, path: str | None = None):
    """A function from texts to token counts for a .json (tokenizers) or .model (sentencepiece) vocabulary."""
    path = _path(name, path)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


class Known(dict):
    """text -> token count; two generations bound the memory while frequent texts stay."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, int] = {}

    def missing(self, texts: set[str]) -> list[str]:
        """Those that are not known; the others are, after this."""
        left = texts.difference(self)
        if left and self.old:
            again = left & self.old.keys()
            self.update({t: self.old[t] for t in again})
            left -= again
        return list(left)

    def tidy(self) -> None:
        if len(self) > KNOWN_PARTS:
            self.old = {t: n for t, n in self.items() if len(t) <= LONG_WORD}
            self.clear()


class PartCounts:
    """Token counts of texts by their parts; a part that recurs is encoded once."""

    def __init__(self, count, whole: bool):
        self.count, self.whole = count, whole
        #: of parts that open a text or piece, and of those that follow a blank
        self.opening, self.following = Known(), Known()

    def of(self, texts: list[bytes]) -> list[int]:
        """The counts of a batch of texts."""
        if self.whole:
            return self.count([t.decode("utf-8", "replace") for t in texts])
        cut = [[chunks(p.decode("utf-8", "replace")) for p in pieces(t)] for t in texts]
        first = self.opening.missing({*MARKS, *(parts[0] for text in cut for parts in text)})
        later = self.following.missing(set().union(*(parts[1:] for text in cut for parts in text)))
        # a mark at the end of a part is a token of its own: what is before it is encoded once with and without it
        stems = {p[:-1] if p[-1:] in MARKS and p[-2:-1].isascii() and p[-2:-1].isalnum() else p for p in later}
        new = self.following.missing(stems)
        counted = self.count([*first, *(f" {p}" for p in new)])
        self.opening.update(zip(first, counted))
        self.following.update(zip(new, counted[len(first) :]))
        opens, follows = self.opening.__getitem__, self.following.__getitem__
        self.following.update({p: follows(p[:-1]) + opens(p[-1]) for p in later if p not in self.following})
        totals = [sum([opens(parts[0]) + sum(map(follows, parts[1:])) for parts in text]) for text in cut]
        self.opening.tidy()
        self.following.tidy()
        return totals


_loaded: dict[tuple, PartCounts] = {}


def load(tokenizer: str, path: str | None, whole: bool) -> PartCounts:
    """One tokenizer, with what it knows, a worker."""
    if (key := (tokenizer, path, whole)) not in _loaded:
        _loaded[key] = PartCounts(counter_of(tokenizer, path), whole)
    return _loaded[key]


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without ``text``, with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    Null texts count as empty: no bytes, no tokens.  Special strings inside texts are handled as the library does by
    default; none are added.  Texts stay whole where ``may_be_cut`` says so, as for sentencepiece, which marks a text's
    start.  Existing columns of the three names are replaced; repeated rows are counted each; an empty table gives an
    empty result.
    """
    bound_batches(docs.sparkSession)
    kept = docs.drop("n_bytes", "n_tokens", "over_limit")
    body = free_name(kept, "body")
    rows = kept.withColumn(body, text_or_empty(text).cast("binary")).drop(text)
    schema = rows.drop(body).schema.add("n_bytes", "long").add("n_tokens", "long")
    whole = not may_be_cut(tokenizer, path)

    def encode(batches):
        counts = load(tokenizer, path, whole)
        for batch in batches:
            texts = batch.column(body).to_pylist()
            totals, start, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BATCH_BYTES or i == len(texts) - 1:
                    totals += counts.of(texts[start : i + 1])
                    start, size = i + 1, 0
            keep = [i for i, n in enumerate(batch.schema.names) if n != body]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array([len(t) for t in texts], pa.int64()), pa.array(totals, pa.int64())],
                names=[*(batch.schema.names[i] for i in keep), "n_bytes", "n_tokens"],
            )

    return rows.mapInArrow(encode, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
