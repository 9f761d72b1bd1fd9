"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word n-grams, hashed to 64 bits.  Equal sets form a class, and classes are what is
joined.  Tokens have one global order, rare ones first; the l-prefix of a set of n tokens is its first
n - ceil(t n) + l tokens, and two sets of similarity t share at least l tokens of their l-prefixes.  Each set picks
its own l: a longer prefix scans more postings but leaves fewer candidates, and the cheapest estimate wins.  A pair
of sets then needs min(l, l') shared prefix tokens before it is verified on the whole sets.

Groups of near copies must not unfold into all pairs.  Round one links every set to one neighbour in the postings
it shares (hot postings are salted), verifies those links and finds components.  Round two searches postings only
across components, and of a list only the sets that have one of another component among those of about their size.  No
pair leaves a task there: a first search keeps the rows of sets that may have a similar one in their cell, by folded
parity bits and then by whole ones, whole sets travel to these rows only, and a second search gives verified links that
connect the sets of a cell, fewer than it has rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, free_name, materialize, mix64, release, table, text_or_empty

#: Tokens whose frequency is known exactly: the most frequent ones, at most so many (16 bytes each).
HEAVY_TOKENS = 1 << 18
#: Counts below this are taken as rare.
HEAVY_FROM = 4
#: A posting list is dealt out in parts of about this many sets, and of about so many tokens, and lists that are searched together in cells of about twice as many rows.
POSTING_ROWS, PART_TOKENS = 1024, 1 << 22
#: Pairs found in lists that a task looks at together, and rows and their bytes.
FOUND_ROWS, HELD_ROWS, HELD_BYTES = 1 << 20, 1 << 13, 1 << 26
#: Shared tokens of a set that travel with each of its rows, those of other lists included; of sets with more, a row has those of its own lists.
CARRIED = 256
MAX_MATCHES = 4
#: Bytes of parity bits that travel with postings at most; the full ones travel once for each pair that is left.
POSTING_BITS = 128
#: Bits of the filter of documents whose sets are needed for verification.
FILTER_BITS = 1 << 23

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Small letters for capital ones; the bytes of a word's last block, by how many there are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (capitals like small letters), all at once: of its length and the sum of mixed blocks of eight bytes, each mixed with its place."""
    data = _LOWER[np.frombuffer(text, np.uint8)]
    edge = np.diff(_SPACE[data].view(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    blocks = (ends - starts + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(blocks.sum()) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", padded.data, 0, (1,))[at].astype(np.uint64) & _KEPT[np.minimum(np.repeat(ends, blocks) - at, 8)]
    with np.errstate(over="ignore"):
        mixed = mix64(eight ^ mix64((place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return mix64(np.add.reduceat(mixed, first) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: bytes, n: int, below: np.uint64 | None = None) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams (ASCII letters lower-cased); fewer words count as one n-gram.  Only those ``below`` a value, if given."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(n, len(h))
    count = len(h) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(count, width, np.uint64)
        for i in range(width):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : count + i])
    return np.unique(out if below is None else out[out < below])


def min_overlap(size, percent: int):
    """The least overlap of a set of this size with any similar one."""
    return (size * percent + 99) // 100


def eligible_below(percent: int) -> np.uint64:
    """Tokens below this value come first in the order, and their frequencies are counted: a hash range that holds several prefixes."""
    part = min(1.0, 2.5 * (100 - percent) / 100)
    return np.uint64(min(int(part * 2**64), 2**64 - 1))


def choose_prefix(hashes: np.ndarray, percent: int, heavy: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The prefix tokens of a (sorted) set, their estimated frequencies and the number of matches asked for."""
    n = len(hashes)
    first = n - min_overlap(n, percent)  # + l tokens
    eligible = int(np.searchsorted(hashes, eligible_below(percent)))
    if eligible >= min(n, first + MAX_MATCHES):
        hashes = hashes[:eligible]  # they hold any prefix
    freq = np.ones(len(hashes), np.int64)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
        freq = np.where(heavy[at] == hashes, counts[at], 1)
    order = np.lexsort((hashes, freq, np.arange(len(hashes)) >= eligible))
    cost = np.cumsum(freq[order[: min(n, first + MAX_MATCHES)]] - 1)  # postings met on the way
    best, matches = None, 1
    for l in range(1, min(MAX_MATCHES, n - first) + 1):
        met = float(cost[first + l - 1])
        # scanning, and verifying at most the sets that fill l matches
        total = met + met / l * (1 + 0.05 * n) + (first + l) * 0.5
        if best is None or total < best:
            best, matches = total, l
    chosen = order[: first + matches]
    return hashes[chosen], freq[chosen], matches


def parity_bits(hashes: np.ndarray, spare: int = 0) -> bytes:
    """A bit for each of 2^k residues, k by the set's size (and ``spare`` more): whether an odd number of hashes falls on it.

    Two such maps differ in at most as many bits as the sets have elements of their own, whatever their sizes.
    """
    width = 1 << max(6, (len(hashes) - 1).bit_length() + spare)
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: bytes, most: int) -> np.ndarray:
    """Parity bits of at most so many bytes: halves laid over each other are the bits of half the width."""
    b = np.frombuffer(bits, np.uint8)
    while len(b) > most:
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return b


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements in one set only, from the two sets' parity bits."""
    width = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum())


def _sets(batches, n: int):
    for batch in batches:
        yield batch, [shingle_set(t, n) for t in batch.column("t").to_pylist()]


def heavy_tokens(rows: DataFrame, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent eligible tokens of all documents with their exact counts, sorted by token."""

    def count(batches):
        below = eligible_below(percent)
        for batch in batches:
            if mine := [shingle_set(t, n, below) for t in batch.column("t").to_pylist()]:
                h, c = np.unique(np.concatenate(mine), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    counted = rows.select("t").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= HEAVY_FROM)
    top = counted.orderBy(F.desc("c"), "h").limit(HEAVY_TOKENS).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def signatures(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """id, n_shingles, cls (digest of the set; null if empty), matches, bits, small (bits folded), prefix [(token, parts)] of each row of (id, t), and its further columns."""
    heavy = rows.sparkSession.sparkContext.broadcast(heavy_tokens(rows, n, percent))  # at most 2 x 8 x HEAVY_TOKENS bytes

    more = [c for c in rows.columns if c not in ("id", "t")]
    carried = "".join(f", {c} {t}" for c, t in rows.dtypes if c in more)

    def sign(batches):
        tokens, counts = heavy.value
        for batch, sets in _sets(batches, n):
            cls, matches, bits, small, toks, parts, ends = [], [], [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [0]
            for s in sets:
                chosen, freq, l = choose_prefix(s, percent, tokens, counts) if len(s) else (s, s, None)
                cls.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                matches.append(l)
                bits.append(parity_bits(s) if len(s) else None)
                small.append(folded(bits[-1], POSTING_BITS).tobytes() if len(s) else None)
                toks.append(chosen.view(np.int64))
                parts.append((-(-freq.astype(np.int64) // POSTING_ROWS)).astype(np.int32))
                ends.append(ends[-1] + len(chosen))
            items = pa.StructArray.from_arrays([pa.array(np.concatenate(toks)), pa.array(np.concatenate(parts))], ["tok", "parts"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array(matches, pa.int32()), pa.array(bits, pa.binary()), pa.array(small, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items), *(batch.column(c) for c in more)],
                names=["id", "n_shingles", "cls", "matches", "bits", "small", "prefix", *more],
            )

    return rows.mapInArrow(sign, "id long, n_shingles long, cls binary, matches int, bits binary, small binary, prefix array<struct<tok:bigint,parts:int>>" + carried)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids, of FILTER_BITS bits whatever their number."""
    at = F.explode(F.array_distinct(F.array(*(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(FILTER_BITS)) for i in range(3)))))
    words = ids.select(at.alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("v")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    return bits


class ParityMaps:
    """The parity bits of many sets, as arrays of each width that is asked for."""

    def __init__(self, bits: list[bytes]):
        self.width = np.fromiter(map(len, bits), np.int64, len(bits))
        self.groups = {int(w): (at := np.flatnonzero(self.width == w), np.frombuffer(b"".join([bits[i] for i in at.tolist()]), np.uint8).reshape(len(at), int(w))) for w in np.unique(self.width)}
        self.words: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each set that is wide enough has its bits, and all bits folded to ``w`` bytes."""
        if w not in self.words:
            place, parts, n = np.zeros(len(self.width), np.int32), [], 0
            for width, (at, bits) in self.groups.items():
                if width >= w:
                    while bits.shape[1] > w:
                        half = bits.shape[1] // 2
                        bits = bits[:, :half] ^ bits[:, half:]
                    place[at] = np.arange(n, n + len(at))
                    parts.append(np.ascontiguousarray(bits))
                    n += len(at)
            self.words[w] = place, np.concatenate(parts).view(np.uint64)
        return self.words[w]

    def agree(self, x: np.ndarray, y: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Whether ``least_difference`` is within what is allowed, for many pairs at once, by widths."""
        out = np.zeros(len(x), bool)
        low = np.minimum(self.width[x], self.width[y])
        for w in np.unique(low).tolist():
            place, words = self._of(w)
            at = np.flatnonzero(low == w)
            for start in range(0, len(at), 1 << 14):
                k = at[start : start + (1 << 14)]
                out[k] = np.bitwise_count(words[place[x[k]]] ^ words[place[y[k]]]).sum(axis=1) <= allowed[k]
        return out


def _pairs_in_cells(t: pa.Table, number: np.ndarray, bits: list[bytes], percent: int, wanted):
    """Index pairs of rows of one cell (``number``) each that may be similar: they share tokens enough, have fitting sizes and parity bits that agree enough.

    ``wanted`` says of rows whether a pair of them is still asked for.  Rows of a cell that comes from two parts
    meet only those of the other one.
    """
    rows = {c: t.column(c).to_numpy().astype(np.int64) for c in ("n", "l", "part", "parts", "cell")}
    order = np.lexsort((rows["n"], number))
    n, l, part, whole = rows["n"][order], rows["l"][order], rows["part"][order], t.column("whole").to_numpy()[order]
    cross = (rows["cell"] // rows["parts"] != rows["cell"] % rows["parts"])[order]
    base, here = number[order] << 32, np.arange(len(order))
    width = np.searchsorted(base + n, base + n * 100 // percent, side="right") - here - 1  # sizes up to n / t follow in order, in the same cell
    lists = t.column("tokens").combine_chunks().take(pa.array(order))
    lists, shared = lists.flatten(), lists.value_lengths().to_numpy()
    tok, place, row = lists.field("tok").to_numpy(), lists.field("i").to_numpy(), np.repeat(here, shared)
    by_list = np.lexsort((row, tok, base[row]))
    tok, place, row = tok[by_list], place[by_list], row[by_list]
    new = np.r_[True, (tok[1:] != tok[:-1]) | (base[row[1:]] != base[row[:-1]])]
    key = np.cumsum(new) * (len(order) + 1)
    follow = np.searchsorted(key + row, key + row + width[row] + 1) - np.arange(len(row)) - 1
    by_row = np.lexsort((place, row))  # the last token that a pair shares comes last
    ends = np.cumsum(shared)
    load = np.cumsum(np.bincount(row, follow, len(order)).astype(np.int64) + width)
    maps, start = ParityMaps([bits[i] for i in order.tolist()]), 0
    while start < len(order):
        stop = max(start + 1, int(np.searchsorted(load, (load[start - 1] if start else 0) + FOUND_ROWS, side="right")))
        entries = by_row[ends[start - 1] if start else 0 : ends[stop - 1]]
        met = follow[entries]
        at = np.repeat(entries, met)
        to = at + 1 + np.arange(len(at)) - np.repeat(np.cumsum(met) - met, met)
        x, y = row[at], row[to]
        keep = (~cross[x] | (part[x] != part[y])) & wanted(order[x], order[y])
        at, to, x, y = at[keep], to[keep], x[keep], y[keep]
        first = np.cumsum(width[start:stop]) - width[start:stop]
        pair = first[x - start] + y - x - 1
        count = np.bincount(pair)
        last = np.zeros(len(count), np.int64)
        last[pair] = np.arange(len(pair))
        found = np.flatnonzero(count)
        c, last = count[found], last[found]
        x, y, ix, iy = x[last], y[last], place[at[last]], place[to[last]]
        start = stop
        # a prefix token before the last shared one that is not shared is in only one of the sets, which bounds the overlap
        most = np.minimum(n[x] - ix - 1 + c, n[y] - iy - 1 + c)
        keep = ~(whole[x] & whole[y]) | (c >= np.minimum(l[x], l[y])) & (most * (100 + percent) >= (n[x] + n[y]) * percent)
        x, y = x[keep], y[keep]
        if len(x):
            both = n[x] + n[y]
            fits = maps.agree(x, y, both - 2 * -(-percent * both // (100 + percent)))
            yield order[x[fits]], order[y[fits]]


def _whole_cells(batches):
    """Tables of whole cells of sorted batches, with the number of each row's cell."""
    held: list[pa.RecordBatch] = []  # the last cell may go on in the next batch

    def numbers(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        for c in ("head", "cell", "bucket"):
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.cumsum(new)

    waiting = size = 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            waiting, size = waiting + len(batch), size + batch.nbytes
            if waiting >= HELD_ROWS or size >= HELD_BYTES:
                t = pa.Table.from_batches(held)
                number = numbers(t)
                if done := int(np.searchsorted(number, number[-1])):
                    yield t.slice(0, done), number[:done]
                    held = t.slice(done).combine_chunks().to_batches()
                waiting = size = 0
    if held:
        t = pa.Table.from_batches(held)
        yield t, numbers(t)


_CELL = "head long, cell int, bucket int, node long, root long, n int, l byte, part int, parts int, whole boolean, tokens array<struct<i:int,tok:bigint>>"
_CELL_COLUMNS = [c.split(" ")[0] for c in _CELL.split(", ")]


def dealt_in_cells(lists: DataFrame) -> DataFrame:
    """The rows (_CELL) of posting lists (tok, head, node, root, n, l, i): a set's tokens in the lists of a head, in each cell that must see it.

    Lists with the same first set (``head``) are searched together, as lists of one group of near copies mostly are:
    their sets are dealt out in parts, and the lists in buckets where their sets are mostly others.  A cell is a part
    by itself or a pair of parts of one bucket, so that no task holds a whole long list or all sets of a large group.
    """
    longest = lists.groupBy("head", "tok").agg(F.count("*").alias("c")).groupBy("head").agg(F.max("c").alias("c"))
    sets = lists.groupBy("head", "node").agg(F.first("n").alias("n")).groupBy("head").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    dealt = longest.join(sets, "head").withColumn("parts", F.ceil(F.greatest(F.col("c") / POSTING_ROWS, F.least(F.col("tokens") / PART_TOKENS, "sets"))).cast("int"))
    dealt = dealt.select("head", "parts", F.ceil(F.col("sets") / F.col("parts") / (2 * POSTING_ROWS)).cast("int").alias("buckets"))
    tokens = F.sort_array(F.collect_list(F.struct("i", "tok"))).alias("tokens")
    bucket = F.pmod(F.xxhash64("tok"), "buckets").cast("int").alias("bucket")
    own = lists.join(dealt, "head").groupBy("head", bucket, "node").agg(*(F.first(c).alias(c) for c in ("root", "n", "l", "parts")), tokens)
    every = lists.groupBy("node").agg(tokens).filter(F.size("tokens") <= CARRIED).withColumnRenamed("tokens", "every")
    part = F.pmod(F.xxhash64("node"), "parts").cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(q, F.col("part")) * F.col("parts") + F.greatest(q, F.col("part")))
    rows = own.join(every, "node", "left").withColumns({"part": part, "whole": F.col("every").isNotNull(), "tokens": F.coalesce("every", "tokens")})
    return rows.withColumn("cell", F.explode(cells)).select(*_CELL_COLUMNS)


def _by_cell(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("head", "cell", "bucket").sortWithinPartitions("head", "cell", "bucket")


def searched_lists(rooted: DataFrame, percent: int) -> DataFrame:
    """The postings (tok, node, root, n, l, i) of a list that are to be searched, with ``head``, the list's first set.

    Similar sets lie in the same band of sizes or in neighbouring ones, so a set is left out of a list that has none of
    another component there: lists of sets that have little but a token in common grow faster than the corpus.
    """
    width = max(math.log(100 / percent), 0.01) * (1 + 1e-6)  # a little more, for what is lost in rounding
    banded = rooted.withColumn("band", F.floor(F.log("n") / width).cast("int"))
    bands = banded.groupBy("tok", "band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("head"))
    list_ = Window.partitionBy("tok")  # of bands, about a hundred at most
    near = list_.orderBy("band").rangeBetween(-1, 1)
    met = bands.select("tok", "band", F.min("x").over(near).alias("x"), F.max("y").over(near).alias("y"), F.min("head").over(list_).alias("head")).filter("x <> y")
    searched = met.groupBy("tok").agg(F.first("head").alias("head"), F.collect_list("band").alias("bands"))
    return banded.join(searched, "tok").filter(F.array_contains("bands", F.col("band"))).drop("band", "bands")


def open_rows(dealt: DataFrame, percent: int, bits: str) -> DataFrame:
    """Of rows (_CELL, ``bits``) those, without ``bits``, that may be similar to one of another component in their cell, by sizes, shared tokens and these parity bits."""

    def search(batches):
        for t, number in _whole_cells(batches):
            root, marked = t.column("root").to_numpy(), np.zeros(len(t), bool)
            for x, y in _pairs_in_cells(t, number, t.column(bits).to_pylist(), percent, lambda x, y: (root[x] != root[y]) & ~(marked[x] & marked[y])):
                marked[x] = marked[y] = True
            yield from t.filter(pa.array(marked)).select(_CELL_COLUMNS).to_batches()

    return _by_cell(dealt).mapInArrow(search, _CELL)


def links_across(dealt: DataFrame, percent: int) -> DataFrame:
    """Similar pairs (a, b) of rows (_CELL, s) of one cell each, by whole sets ``s``: enough to connect what is linked there across components."""

    def search(batches):
        above: dict[int, int] = {}  # of roots that this task has connected

        def top(r: int) -> int:
            while (up := above.get(r, r)) != r:
                above[r] = r = above.get(up, up)
            return r

        for t, number in _whole_cells(batches):
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("s").combine_chunks()]
            roots, which = np.unique(t.column("root").to_numpy(), return_inverse=True)
            now = np.array([top(r) for r in roots.tolist()], np.int64)[which]
            nodes, links = t.column("node").to_pylist(), []
            for x, y in _pairs_in_cells(t, number, [parity_bits(s, 3) for s in sets], percent, lambda x, y: now[x] != now[y]):
                before = len(links)
                for i, j in zip(x.tolist(), y.tolist()):
                    a, b = top(int(now[i])), top(int(now[j]))
                    if a != b and are_similar(sets[i], sets[j], percent):
                        above[max(a, b)] = min(a, b)
                        links.append((nodes[i], nodes[j]))
                if len(links) > before:
                    now = np.array([top(r) for r in roots.tolist()], np.int64)[which]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    return _by_cell(dealt).mapInArrow(search, "a long, b long")


def promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their parity bits do not rule out: whole sets are far larger and travel only for these."""

    def keep(batches):
        for batch in batches:
            ok = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "na", "nb"))):
                overlap = -(-percent * (n + m) // (100 + percent))
                ok.append(least_difference(x, y) <= n + m - 2 * overlap)
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    side = lambda s, x: classes.select(F.col("node").alias(s), F.col("bits").alias(x), F.col("n").alias(f"n{s}"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", "na", "nb")
    return both.mapInArrow(keep, "a long, b long")


def are_similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether 100 * overlap >= percent * union of two sorted sets."""
    both = np.sort(np.concatenate([s, t]), kind="stable")  # two sorted runs: a merge
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(s) + len(t) - common)


def whole_sets(nodes: DataFrame, rows: DataFrame, classes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """node, key of the nodes, as a table that goes when the sets have been read, and key, s: their sets, made anew from one document of each class.

    The key is the class and the document's id: sets meet what asks for them by it, and are not shuffled to their nodes first.
    """
    key = F.concat("cls", F.coalesce(F.unhex(F.lpad(F.hex("id"), 16, "0")), F.lit(b"")))
    need = materialize(nodes.distinct().join(classes.select("node", "id", key.alias("key")), "node"), "join-need")
    bits = nodes.sparkSession.sparkContext.broadcast(_filter_of(need))
    positions = F.array(*(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(FILTER_BITS)) for i in range(3)))

    def make(batches):
        for batch in batches:
            at = batch.column("at").flatten().to_numpy().reshape(-1, 3)
            held = (bits.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            part = batch.filter(pa.array(held.all(axis=1)))
            sets = [shingle_set(t, n).tobytes() for t in part.column("t").to_pylist()]
            ids = (b"" if i is None else i.to_bytes(8, "big", signed=True) for i in part.column("id").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(s).digest() + i for s, i in zip(sets, ids)], pa.binary()), pa.array(sets, pa.binary())], names=["key", "s"])

    made = rows.select("id", "t", positions.alias("at")).mapInArrow(make, "key binary, s binary")
    # rows that repeat id and text give a set more than once
    return need, made.groupBy("key").agg(F.first("s").alias("s"))


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) of classes whose whole sets are similar."""
    need, sets = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), rows, classes, n)

    def compare(batches):
        for batch in batches:
            keep = [are_similar(np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64), percent) for s, t in zip(batch.column("x"), batch.column("y"))]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    both = pairs
    for side in "ab":
        both = both.join(need.select(F.col("node").alias(side), F.col("key").alias(f"key_{side}")), side)
    for side, s in (("a", "x"), ("b", "y")):
        both = both.join(sets.select(F.col("key").alias(f"key_{side}"), F.col("s").alias(s)), f"key_{side}")
    links = materialize(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "join-links")
    discard(need)
    return links


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the links reaches, as a table.  Alternating large and small stars."""
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "cc-edges")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        hi, lo = F.greatest("a", "b"), F.least("a", "b")
        if large:
            out = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        else:
            out = edges.select(hi.alias("u"), lo.alias("v"))
        least = out.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        with_min = out.join(least, "u")
        if large:
            return with_min.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        ends = with_min.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return ends.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()

    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, now = None, mark(edges)
    while now != before and now[0]:
        last, edges = edges, materialize(star(star(edges, True), False), "cc-edges")
        before, now = now, mark(edges)
        discard(last)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
    roots = materialize(roots, "cc-roots")
    discard(edges)
    return roots


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after further links, as a table; nodes that ``roots`` does not have are their own roots before.  Both inputs are tables, which go."""
    root = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    across = links.join(root, "a", "left").join(root.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    found = components(across)
    more = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(more, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = more.join(roots, more.root == roots.node, "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    all_ = materialize(moved.unionByName(new), "join-roots")
    discard(roots, links, found)
    return all_


def link_components(rows: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id of each row of (id long, t binary), its further columns, and ``root``.

    ``root`` tells components apart whatever their ids: component_id is null where all ids of one are, and null itself
    is the root of rows without words.  See ``join_components``.
    """
    spark = rows.sparkSession
    more = [c for c in rows.columns if c not in ("id", "t")]
    bound_batches(spark)
    wide = materialize(signatures(rows, n, percent), "join-wide")
    release(spark)
    signed = materialize(wide.select("id", "n_shingles", "cls", *more), "join-signed")
    full = signed.filter("cls is not null")
    grouped = wide.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.first(F.struct("n_shingles", "matches", "bits", "small", "prefix")).alias("p"))
    numbered = materialize(grouped.select(F.monotonically_increasing_id().alias("node"), "cls", "id", F.col("p.n_shingles").cast("int").alias("n"), F.col("p.matches").cast("byte").alias("l"), "p.bits", "p.small", "p.prefix"), "join-numbered")
    discard(wide)
    classes = materialize(numbered.drop("l", "small", "prefix"), "join-classes")

    # postings that more than one class has
    posted = numbered.select("node", "n", "l", F.size("prefix").alias("k"), F.posexplode("prefix").alias("i", "p")).select("node", "n", "l", "k", "i", "p.tok", "p.parts")
    common = numbered.select(F.explode("prefix.tok").alias("tok")).groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1").select("tok")
    posted = materialize(posted.join(common, "tok", "left_semi"), "join-posted")
    release(spark)

    # round one: a neighbour in each posting list, in parts, the parts' first sets in a chain of their own; of the
    # neighbours the one met most often is verified, if that is often enough to be promising
    dealt = posted.select("node", "n", "k", "tok", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    w = Window.partitionBy("tok", "part").orderBy("n", "node")
    chain = dealt.select("*", F.lag(F.struct("node", "n")).over(w).alias("p"))
    heads = chain.filter("p is null").drop("p")
    heads = heads.select("*", F.lag(F.struct("node", "n")).over(Window.partitionBy("tok").orderBy("n", "node")).alias("p"))
    near = chain.unionByName(heads).filter("p is not null").filter(F.col("p.n") * 100 >= F.col("n") * percent)
    best = near.groupBy("node", F.col("p.node").alias("b")).agg(F.count("*").alias("c"), F.first("k").alias("k")).filter("3 * c >= k").groupBy("node").agg(F.max(F.struct("c", "b")).alias("m"))
    pairs = materialize(promising(best.select(F.col("node").alias("a"), F.col("m.b").alias("b")), classes, percent), "join-near")
    links = verified(pairs, rows, classes, n, percent)
    first = components(links)
    discard(pairs, links)

    # round two: posting lists that several components share, searched across components
    rooted = posted.join(first, "node", "left").withColumn("root", F.coalesce("root", "node")).select("tok", "node", "root", "n", "l", "i")
    lists = materialize(searched_lists(rooted, percent), "join-lists")
    discard(posted)
    open_ = open_rows(dealt_in_cells(lists).join(numbered.select("node", "small"), "node"), percent, "small")
    left = materialize(open_rows(open_.join(classes.select("node", "bits"), "node"), percent, "bits"), "join-open")
    discard(lists, numbered)
    need, sets = whole_sets(left.select("node"), rows, classes, n)
    links = materialize(links_across(left.join(need.select("node", "key"), "node").join(sets, "key"), percent), "join-links")
    discard(left, need)
    last = joined_roots(first, links)
    final = classes.select("node", "cls", "id").join(last, "node", "left").withColumn("r", F.coalesce("root", "node")).select("cls", "id", "r")
    named = final.join(final.groupBy("r").agg(F.min("id").alias("component_id")), "r").select("cls", "component_id", F.col("r").alias("root"))
    out = full.join(named, "cls").select("id", "n_shingles", "component_id", *more, "root")
    return out.unionByName(signed.filter("cls is null").select("id", "n_shingles", F.col("id").alias("component_id"), *more, F.lit(None).cast("long").alias("root")))


def join_components(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) of each document.

    Two documents link when 100 * overlap >= percent * union of their sets.  Null texts count as empty; documents
    without words are linked with nothing.  Repeated rows are documents of one class; a document with a null id
    joins its class and has the class's smallest id (null if there is none).  An empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).cast("binary").alias("t"))
    return link_components(rows, n, percent).select(F.col("id").alias(key), "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last), and of equal ids the first by text's digest.

    A document without words is a component of its own, and so is each such row without an id; rows that repeat id and
    text are one document.
    """
    label, order = free_name(docs, "document"), free_name(docs, "order")
    body = text_or_empty(text)
    # id and text in one digest: rows of one id may differ in their texts, and rows of one text in their ids
    digest = F.unhex(F.md5(F.concat(F.coalesce(F.col(key).cast("long").cast("string"), F.lit("")), F.lit(":"), body)))
    nameless = F.col(key).isNull() & ~body.rlike(r"[^\x20\x09-\x0D]")
    linked = link_components(docs.filter(~nameless).select(F.col(key).cast("long").alias("id"), body.cast("binary").alias("t"), digest.alias("row")), n, percent)
    first = linked.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("m")).select("m.row")
    kept = first.unionByName(linked.filter("root is null").select("row").distinct()).withColumnRenamed("row", label)
    rows = docs.filter(~nameless).withColumn(label, digest).join(kept, label, "left_semi")
    single = rows.withColumn(order, F.row_number().over(Window.partitionBy(label).orderBy(label))).filter(F.col(order) == 1)
    return single.select(*docs.columns).unionByName(docs.filter(nameless))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), 3, 90)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS sh FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh), len(sh)),
e AS (SELECT rep, n, unnest(sh) AS tok FROM c),
f AS (SELECT tok, count(*) AS df FROM e GROUP BY tok HAVING count(*) > 1),
o AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
  FROM e a JOIN f USING (tok) JOIN e b ON a.tok = b.tok AND a.rep < b.rep AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY a.rep, b.rep),
l AS (SELECT x, y FROM o WHERE 100 * k >= 90 * (nx + ny - k)),
both_ways AS (SELECT x, y FROM l UNION SELECT y, x FROM l UNION SELECT rep, rep FROM c),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
m AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh AND len(s.sh) > 0 LEFT JOIN m ON m.rep = c.rep
"""
