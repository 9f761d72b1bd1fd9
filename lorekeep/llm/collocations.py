"""Phrase collocations by vertical positional inverted lists.

Texts are packed into blocks of one language; a word's list in a block is the sorted positions at which it occurs.
Frequent phrases are extended by a word at a time: the positions of a phrase are merge-joined with the positions, moved back
by one, of the phrases of the same length beside it, and what meets is the list of the longer phrase, whose last word is
the second phrase's.  The lengths of its lists, summed over all blocks, are a phrase's exact frequency; only lists of phrases that
are frequent in the whole language are extended further.

Lists stay in the row of their block, so that no position is ever shuffled by its phrase: what is sent are the
(phrase, next word, length of list) of a block, sorted and packed in ranges of their hash, and so are the words at first.  A range
sums them over all blocks and answers each block which of its candidates are frequent; the block then meets the lists again
and keeps those.  Blocks end between pieces.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bound_batches, discard, materialize, mix64, pack, release, table, text_or_empty, unpack

BLOCK_WORDS, SLICE_BYTES, RANGE_WORDS = 1 << 20, 1 << 22, 1 << 20
MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: Never a byte of UTF-8: stands where a piece ends.
_END = 0xFF
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + bytes([_END]) * 10)


def slices(text: bytes, limit: int = SLICE_BYTES):
    """Parts of ``text`` (whose pieces end with the end byte) of about ``limit`` bytes, cut where a piece ends."""
    start = 0
    while len(text) - start > limit:
        cut = text.find(_END, start + limit)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


class Block:
    """Words of one language, numbered as they come, and the number at each position; -1 where a piece ends."""

    def __init__(self):
        self.codes, self.parts, self.size = {bytes([_END]): -1}, [], 0

    def add(self, text: bytes) -> None:
        codes = self.codes
        words = text.replace(bytes([_END]), b" \xff ").split()
        for w in set(words).difference(codes):
            codes[w] = len(codes) - 1
        words.append(bytes([_END]))
        self.parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def lists(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words, how often each occurs, and the positions of the first, the second, and so on."""
        at = np.concatenate(self.parts)
        order = np.argsort(at, kind="stable").astype(np.uint32)
        ends = int((at < 0).sum())
        words = list(self.codes)[1:]
        return [w.decode() for w in words], np.bincount(at[at >= 0], minlength=len(words)), order[ends:]


_FIRST = "lang string, words array<string>, sizes array<long>, at binary"


def word_lists(rows: DataFrame) -> DataFrame:
    """Blocks of rows (lang, text as bytes): words, the sizes of their lists, and the lists one after another."""

    def run(batches):
        open_blocks: dict[str, Block] = {}

        def close(lang):
            words, sizes, at = open_blocks.pop(lang).lists()
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([words], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int64())), pa.array([pack([at])], pa.binary())],
                names=["lang", "words", "sizes", "at"],
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("body")):
                for part in slices(text.as_py().translate(_PLAIN)):
                    block = open_blocks.setdefault(lang, Block())
                    block.add(part)
                    if block.size >= BLOCK_WORDS:
                        yield close(lang)
        for lang in list(open_blocks):
            yield close(lang)

    return rows.mapInArrow(run, _FIRST).filter(F.size("words") > 0).withColumn("blk", F.monotonically_increasing_id())


class Lists:
    """Lists of positions by number of their phrase, in the order of positions."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray):
        order = np.argsort(at, kind="stable")
        self.at, self.phrase = at[order], np.repeat(np.arange(len(sizes)), sizes)[order]

    def meet(self, at: np.ndarray) -> np.ndarray:
        """The index here of each of the sorted positions ``at``, or -1."""
        if not len(self.at):
            return np.full(len(at), -1)
        i = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
        return np.where(self.at[i] == at, i, -1)


def extend(phrases: Lists, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a word more in one block: numbers of their first words' phrase, ids of their last word, sizes and lists.

    ``lasts`` are the ids of the phrases' last words, by number.  The phrase without its first word must be frequent too.
    """
    after = phrases.meet(phrases.at + 1)
    met = after >= 0
    words, word = np.unique(lasts, return_inverse=True)
    many = max(1, len(words))
    key = phrases.phrase[met].astype(np.int64) * many + word[phrases.phrase[after[met]]]
    order = np.argsort(key, kind="stable")
    distinct, sizes = np.unique(key, return_counts=True)
    return distinct // many, words[distinct % many], sizes, phrases.at[met][order]


_LISTS = "blk long, ids array<long>, lasts array<long>, sizes array<long>, at binary"
_LONGS = pa.list_(pa.int64())
_KINDS = [pa.int64(), _LONGS, _LONGS, _LONGS, pa.binary()]


def _longs(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _list(column: pa.Array, i: int, size: int) -> np.ndarray:
    return unpack(column[i].as_buffer(), size, ["<u4"])[0].astype(np.int64)


def _regrouped(sizes: np.ndarray, at: np.ndarray, kept: np.ndarray, ids: np.ndarray, lasts: np.ndarray) -> list:
    """Ids in ascending order, last words, sizes and packed positions of the lists ``kept``."""
    number, order = np.full(len(sizes), -1), np.argsort(ids)
    number[kept[order]] = np.arange(len(ids))
    phrase = np.repeat(number, sizes)
    at, phrase = at[phrase >= 0], phrase[phrase >= 0]
    return [ids[order], lasts[order], np.bincount(phrase, minlength=len(ids)), pack([at[np.argsort(phrase, kind="stable")].astype(np.uint32)])]


def _rows(rows: list[list], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)


def _extended(of: dict[str, pa.Array], i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of a word more in a block, by the ids of their first words and their last word; sizes and lists."""
    ids, sizes = _longs(of["ids"], i), _longs(of["sizes"], i)
    first, last, found, at = extend(Lists(sizes, _list(of["at"], i, sizes.sum())), _longs(of["lasts"], i))
    return ids[first], last, found, at


def _in_ranges(deal: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates in the order of their ranges, and where each range begins."""
    return np.argsort(deal, kind="stable"), np.searchsorted(np.sort(deal), np.arange(ranges + 1))


def _dealt(pid: np.ndarray, wid: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    return _in_ranges((mix64(mix64(pid.astype(np.uint64)) + wid.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64), ranges)


def _dealt_words(words: list[str], ranges: int) -> tuple[np.ndarray, np.ndarray]:
    return _in_ranges(np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % ranges, ranges)


_WORDS = "rng long, blk long, lang string, n long, words binary, sizes binary"
_WORD_ANSWERS = "blk long, rng long, lang string, words array<string>, f array<long>, j array<long>, id array<long>"


def word_candidates(every: DataFrame, ranges: int) -> DataFrame:
    """A row a block and range: words (joined by a blank, which none holds) and sizes of their lists packed, in their order in the block."""

    def run(batches):
        for batch in batches:
            of = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                words, sizes = of["words"][i].as_py(), _longs(of["sizes"], i)
                order, starts = _dealt_words(words, ranges)
                rows = []
                for r in np.flatnonzero(np.diff(starts)):
                    mine = order[starts[r] : starts[r + 1]]
                    packed = zstandard.ZstdCompressor(level=1).compress(" ".join([words[j] for j in mine.tolist()]).encode())
                    rows.append([int(r), of["blk"][i].as_py(), of["lang"][i].as_py(), len(mine), packed, pack([sizes[mine]])])
                if rows:
                    yield _rows(rows, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()], _WORDS)

    return every.mapInArrow(run, _WORDS)


def counted_words(dealt: DataFrame, least: int) -> DataFrame:
    """Of each range the words with ``least`` occurrences or more in all blocks of a language: words, f and id in a row with
    blk -1 a language, and a row a block with the places (j) and ids of its own."""

    def run(key, table):
        rng, rows, given = key[0].as_py(), [], 0
        langs = table.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            mine = table.take(pa.array([i for i, x in enumerate(langs) if x == lang]))
            n = mine.column("n").to_pylist()
            words = [w for x in mine.column("words") for w in zstandard.ZstdDecompressor().decompress(x.as_buffer()).decode().split(" ")]
            sizes = np.concatenate([unpack(x.as_buffer(), m, ["<i8"])[0] for x, m in zip(mine.column("sizes"), n)])
            coded = pa.array(words).dictionary_encode()
            which = coded.indices.to_numpy()
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, which, sizes)
            good = np.flatnonzero(total >= least)
            ids = np.full(len(total), -1)
            ids[good] = (rng << 32) + given + np.arange(len(good))
            given += len(good)
            if len(good):
                rows.append([-1, rng, lang, coded.dictionary.take(pa.array(good)).to_pylist(), total[good], None, ids[good]])
            for blk, of in zip(mine.column("blk").to_pylist(), np.split(ids[which], np.cumsum(n)[:-1])):
                j = np.flatnonzero(of >= 0)
                if len(j):
                    rows.append([blk, rng, None, None, None, j, of[j]])
        return pa.Table.from_batches([_rows(rows, [pa.int64()] * 2 + [pa.string(), pa.list_(pa.string())] + [_LONGS] * 3, _WORD_ANSWERS)])

    return dealt.groupBy("rng").applyInArrow(run, _WORD_ANSWERS)


def _told(lists: DataFrame, answers: DataFrame) -> DataFrame:
    """Lists with the answers to their block.  Both sides are dealt by block whatever their sizes: answers grow with the corpus."""
    told = answers.filter("blk >= 0").groupBy("blk").agg(F.collect_list(F.struct("rng", "j", "id")).alias("told"))  # those of one block
    return lists.join(told.hint("merge"), "blk")


def _places(told: pa.StructArray, order: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates of a block are frequent, and their ids."""
    places = [order[starts[r] + j.values.to_numpy(zero_copy_only=False)] for r, j in zip(told.field("rng").to_pylist(), told.field("j"))]
    return np.concatenate(places), told.field("id").flatten().to_numpy(zero_copy_only=False)


def frequent_words(every: DataFrame, answers: DataFrame, ranges: int) -> DataFrame:
    """The lists of frequent words, from all lists and the answers of ``counted_words``."""

    def run(batches):
        for batch in batches:
            of = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                sizes = _longs(of["sizes"], i)
                kept, ids = _places(of["told"][i].values, *_dealt_words(of["words"][i].as_py(), ranges))
                yield _rows([[of["blk"][i].as_py(), *_regrouped(sizes, _list(of["at"], i, sizes.sum()), kept, ids, ids)]], _KINDS, _LISTS)

    return _told(every.drop("lang"), answers).mapInArrow(run, _LISTS)


_CANDIDATES = "rng long, blk long, n long, packed binary"
_ANSWERS = "blk long, rng long, pid array<long>, wid array<long>, f array<long>, j array<long>, id array<long>"


def candidates(lists: DataFrame, ranges: int) -> DataFrame:
    """A row a block and range: candidates (first words, last word, size of list) packed, in their order in the block."""

    def run(batches):
        for batch in batches:
            of = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                pid, wid, sizes, _ = _extended(of, i)
                order, starts = _dealt(pid, wid, ranges)
                rows = []
                for r in np.flatnonzero(np.diff(starts)):
                    mine = order[starts[r] : starts[r + 1]]
                    rows.append([int(r), of["blk"][i].as_py(), len(mine), pack([np.diff(pid[mine], prepend=0), wid[mine], sizes[mine]])])
                if rows:
                    yield _rows(rows, [pa.int64()] * 3 + [pa.binary()], _CANDIDATES)

    return lists.mapInArrow(run, _CANDIDATES)


def counted(dealt: DataFrame, least: int) -> DataFrame:
    """Of each range the candidates with ``least`` occurrences or more in all blocks: pid, wid, f and id in a row with blk -1,
    and a row a block with the places (j) and ids of its own."""

    def run(key, table):
        n = table.column("n").to_numpy()
        parts = [unpack(x.as_buffer(), m, ["<i8"] * 3) for x, m in zip(table.column("packed"), n)]
        pid = np.concatenate([np.cumsum(p[0]) for p in parts])
        wid, sizes = (np.concatenate([p[c] for p in parts]) for c in (1, 2))
        (firsts, first), (lasts, last) = np.unique(pid, return_inverse=True), np.unique(wid, return_inverse=True)
        pairs, which = np.unique(first * len(lasts) + last, return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, which, sizes)
        good = np.flatnonzero(total >= least)
        rng, longs = key[0].as_py(), _LONGS
        ids = np.full(len(pairs), -1)
        ids[good] = (rng << 32) + np.arange(len(good))
        rows = [[-1, rng, firsts[pairs[good] // len(lasts)], lasts[pairs[good] % len(lasts)], total[good], None, ids[good]]] if len(good) else []
        for blk, of in zip(table.column("blk").to_pylist(), np.split(ids[which], np.cumsum(n)[:-1])):
            j = np.flatnonzero(of >= 0)
            if len(j):
                rows.append([blk, rng, None, None, None, j, of[j]])
        kinds = [pa.int64()] * 2 + [longs] * 5
        return pa.Table.from_batches([_rows(rows, kinds, _ANSWERS)])

    return dealt.groupBy("rng").applyInArrow(run, _ANSWERS)


def longer_lists(lists: DataFrame, answers: DataFrame, ranges: int) -> DataFrame:
    """Lists of the frequent phrases of a word more, from lists and the answers of ``counted``."""

    def run(batches):
        for batch in batches:
            of = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                pid, wid, sizes, at = _extended(of, i)
                kept, ids = _places(of["told"][i].values, *_dealt(pid, wid, ranges))
                yield _rows([[of["blk"][i].as_py(), *_regrouped(sizes, at, kept, ids, wid[kept])]], _KINDS, _LISTS)

    return _told(lists, answers).mapInArrow(run, _LISTS)


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS, text: str = "text", lang: str = "lang", range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to ``longest`` words with ``least`` occurrences or more, and (lang, n) of all words.

    Letters A to Z are lower-cased, pieces are split at ``.,;:!?`` and line ends, words at blanks and tabs; phrases lie
    within pieces, and overlapping occurrences count each.  A null language is ``und``, a null text is empty.  Rows
    that repeat count each; empty tables give empty ones; other columns are ignored.

    Candidates are counted in ranges of their hash, one for each ``range_words`` words of the corpus: blocks send
    a range its candidates packed, and it answers which of them are frequent.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).cast("binary").alias("body"))
    every = materialize(word_lists(rows), "word-lists", "zstd")
    totals = materialize(every.groupBy("lang").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")), "totals")
    ranges = -(-(totals.agg(F.sum("n")).first()[0] or 1) // range_words)
    answers = materialize(counted_words(word_candidates(every, ranges), least), "answers-1", "zstd")
    release(spark)
    of = answers.filter("blk < 0").select("lang", F.explode(F.arrays_zip("words", "f", "id")).alias("of"))
    words = materialize(of.select("lang", F.col("of.words").alias("phrase"), F.col("of.f").alias("f"), F.col("of.id").alias("id")), "frequent-1")
    lists = materialize(frequent_words(every, answers, ranges), "lists-1", "zstd")
    discard(every, answers)
    phrases = [words]
    for length in range(2, longest + 1):
        answers = materialize(counted(candidates(lists, ranges), least), f"answers-{length}", "zstd")
        release(spark)
        of = answers.filter("blk < 0").select(F.explode(F.arrays_zip("pid", "wid", "f", "id")).alias("of")).select("of.*")
        first = phrases[-1].select("lang", F.col("id").alias("pid"), F.col("phrase").alias("first"))
        last = words.select(F.col("id").alias("wid"), F.col("phrase").alias("last"))
        named = of.join(first, "pid").join(last, "wid")
        phrases.append(materialize(named.select("lang", "id", "f", F.concat_ws(" ", "first", "last").alias("phrase")), f"frequent-{length}"))
        if length < longest:
            longer = materialize(longer_lists(lists, answers, ranges), f"lists-{length}", "zstd")
            discard(lists, answers)
            lists = longer
    discard(lists, answers) if longest > 1 else discard(lists)
    return reduce(DataFrame.unionByName, [p.select("lang", "phrase", F.lit(k + 1).alias("k"), "f") for k, p in enumerate(phrases)]), totals


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def _whole(x: Column, digits: int) -> Column:
    return x.cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP, cover: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words.

    A phrase scores floor(1000 a n / (l r)) at the cut into two parts where that is least (of equal cuts the first), a
    its frequency, l and r those of the parts, n the number of words.  Phrases that lie inside a longer one with
    ``cover`` percent of their frequency or more are left out.  Order: score and frequency descending, phrase
    ascending by bytes.  Products are decimals of 38 digits: exact for up to 10^15 words a language.
    """
    phrases, totals = frequent_phrases(docs, least, longest, text, lang)
    candidates = phrases.filter("k > 1")
    w = F.transform(F.array(_words(F.col("phrase"))), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(
        i.alias("i"), F.array_join(F.slice(w, F.lit(1), i), " ").alias("left"), F.array_join(F.slice(w, i + 1, F.size(w)), " ").alias("right"),
    )))[0]
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(w).alias("cut")).select("lang", "phrase", "a", "cut.*")
    part = lambda side, f: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(F.broadcast(totals), "lang")  # a row a language
    value = F.call_function("div", _whole(F.col("a"), 18) * _whole(F.col("n") * 1000, 19), _whole(F.col("l"), 18) * _whole(F.col("r"), 18))
    least_cut = scored.withColumn("score", value).groupBy("lang", "phrase").agg(F.min(F.struct("score", "i", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    inner = F.transform(F.array(_words(F.col("phrase"))), lambda w: F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " ")
    ))))[0]
    covering = phrases.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("covered"))
    kept = least_cut.join(covering, ["lang", "phrase"], "left").filter(F.col("covered").isNull() | (_whole(F.col("covered"), 18) * 100 < _whole(F.col("a"), 18) * cover))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), numbered AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM numbered GROUP BY lang),
occurrences AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM numbered, range(1, 6) AS ks(k)),
phrases AS (SELECT lang, k, phrase, count(*) AS f FROM occurrences GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT p.lang, p.phrase, p.f AS a, i, array_to_string(string_split(p.phrase, ' ')[1:i], ' ') AS left_part, array_to_string(string_split(p.phrase, ' ')[i + 1:], ' ') AS right_part
  FROM phrases p, range(1, 5) AS cs(i) WHERE i < p.k
),
scored AS (
  SELECT c.lang, c.phrase, c.i, c.a, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN phrases l ON l.lang = c.lang AND l.phrase = c.left_part JOIN phrases r ON r.lang = c.lang AND r.phrase = c.right_part JOIN totals t ON t.lang = c.lang
),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner_phrases AS (
  SELECT p.lang, array_to_string(string_split(p.phrase, ' ')[i:i + m - 1], ' ') AS phrase, max(p.f) AS f
  FROM phrases p, range(1, 5) AS starts(i), range(2, 5) AS sizes(m) WHERE m < p.k AND i + m - 1 <= p.k GROUP BY ALL
),
ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, encode(l.phrase)) AS rank
  FROM least l LEFT JOIN inner_phrases s ON s.lang = l.lang AND s.phrase = l.phrase WHERE s.f IS NULL OR s.f < l.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""
