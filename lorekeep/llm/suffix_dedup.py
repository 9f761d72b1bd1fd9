"""Removal of repeated byte strings by a distributed suffix array (difference cover modulo three).

A byte goes if a string of ``length`` bytes covers it that starts anywhere else too.  Three steps:

1.  Texts are cut into runs of window starts that share an anchor, the least hash of the first grams of a window.  Equal
    windows have equal anchors at the same place, so a run whose core (what every window of its anchor begins with, past
    the anchor) occurs once repeats nothing.  Of runs that are equal as a whole, with all their windows, one goes on to
    the sort.  Both are exact: nothing is dropped but what cannot match, or what is there in a copy.
2.  The suffixes of what is left are sorted.  A position's class is its unit's number modulo three (units of five bytes on
    the text, of one name above it).  Classes 1 and 2 are the sample: their triples of units are sorted and named, and
    the string of names is sorted in the same way, until a name stands for ``length`` bytes.  On the way back class 0 is
    sorted by its first unit and the next position's rank, and merged into the sample by the comparisons that the
    difference cover allows.
3.  Adjacent suffixes are compared: where their first ``length`` bytes agree, both windows are repeated.

Texts lie in blocks of a few megabytes.  What a sort needs of a position's surroundings is in its block, so each level
takes two shuffles, of packed columns: to the range of the first symbol, where triples are named or suffixes merged,
and back to the block.  No task holds more than one block or one range of about ``PART`` suffixes, nothing but samples
for the bounds of ranges reaches the driver, and every level is written to the shared folder.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import bound_batches, discard, free_name, materialize, mix64, pack, release, table, text_or_empty, unpack

LENGTH = 400
GRAM, UNIT = 8, 5
#: Window starts of a text that are looked at in one go, bytes of a block, suffixes of a range, samples of a block.
SLICE, BLOCK, PART, SAMPLES = 1 << 20, 1 << 22, 1 << 20, 256
_LOW = np.uint64(0xFFFFFFFF)


def least_gram(length: int) -> int:
    """How many grams of a window are looked at for its anchor."""
    return max(1, length // 3)


def anchors(text: memoryview, length: int):
    """Runs of window starts that share an anchor: arrays of the first start, the last start, and the anchor.

    The anchor of a window is the rightmost least hash of its first ``least_gram`` grams.  Runs end where slices do.
    """
    width, starts = least_gram(length), len(text) - length + 1
    for begin in range(0, starts, SLICE):
        end = min(starts, begin + SLICE)
        part = text[begin : end + width + GRAM - 2]
        count = len(part) - GRAM + 1
        grams = np.ndarray((count,), "<u8", part, 0, (1,)).astype(np.uint64)
        value = (mix64(grams) & ~_LOW) | (_LOW - np.arange(count, dtype=np.uint64))
        padded = np.full(-(-count // width) * width, np.uint64(2**64 - 1))
        padded[:count] = value
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: end - begin], ahead[width - 1 : width - 1 + end - begin])
        at = (_LOW - (least & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        yield begin + first, begin + last, begin + at[first]


def runs(texts: DataFrame, length: int) -> DataFrame:
    """(tid, lo, hi, core, whole) of the texts' runs: hashes of the core and of all bytes of the run's windows."""
    core = length - least_gram(length) + 1

    def run(batches):
        for batch in batches:
            made: list[list[np.ndarray]] = [[], [], [], [], []]
            for tid, body in zip(batch.column("tid").to_pylist(), batch.column("body")):
                text = memoryview(body.as_buffer())
                for lo, hi, at in anchors(text, length):
                    cores = [xxhash.xxh3_64_intdigest(text[a : a + core]) for a in at.tolist()]
                    wholes = [xxhash.xxh3_64_intdigest(text[a:b], 1) for a, b in zip(lo.tolist(), (hi + length).tolist())]
                    for column, values in zip(made, (np.full(len(lo), tid), lo, hi, np.array(cores, np.uint64).view(np.int64), np.array(wholes, np.uint64).view(np.int64))):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in made], names=["tid", "lo", "hi", "core", "whole"])

    return texts.select("tid", "body").mapInArrow(run, "tid long, lo long, hi long, core long, whole long")


def join_by_frequency(rows: DataFrame, known: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with ``known``, whose column ``n`` says how many of the ``total`` rows have a key.

    Keys of a thousandth of the rows or more, which are a thousand at most, are broadcast, so that no task gets all rows of
    a frequent key; the others meet by shuffle.
    """
    frequent = F.col(n) * 1000 >= total
    heavy = known.filter(frequent)
    rare = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(known.filter(~frequent), on)
    return rows.join(F.broadcast(heavy), on).unionByName(rare)


def repeated_runs(every: DataFrame) -> DataFrame:
    """(tid, lo, hi, full, sort): runs whose core recurs; ``full`` if the whole recurs, ``sort`` if its windows must be compared."""
    total = every.count()
    again = materialize(every.groupBy("core").agg(F.count(F.lit(1)).alias("all")).filter("all > 1"), "cores", "zstd")
    some = materialize(join_by_frequency(every, again, ["core"], "all", total).drop("all"), "recurring-runs", "zstd")
    kinds = materialize(some.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tid", "lo")).alias("first")), "kinds", "zstd")
    cores = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"))
    classes = materialize(join_by_frequency(kinds, cores, ["core"], "kinds", total), "classes", "zstd")
    full = F.col("n") > 1
    joined = join_by_frequency(some, classes, ["core", "whole"], "n", total)
    flags = joined.select("tid", "lo", "hi", full.alias("full"), ((F.col("kinds") > 1) & (~full | (F.col("first") == F.struct("tid", "lo")))).alias("sort"))
    out = materialize(flags.distinct(), "repeated-runs", "zstd")  # copies of a text have the same runs
    discard(again, some, kinds, classes)
    return out


def blocks(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(blk, n, starts, body, tids, at, lo): the stretches of the texts that hold the wanted runs, packed into blocks.

    ``starts`` are the window starts within the block; ``tids``, ``at`` and ``lo`` name each stretch's text, its place in
    the block and its place in the text.
    """
    pad = bytes(2 * length + 64)

    def run(batches):
        body, starts, of, size = [], [], [], 0

        def close():
            packed = b"".join([*body, pad])
            at = np.concatenate(starts).astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([len(packed)]), pa.array([at.tobytes()]), pa.array([packed]), *(pa.array([[x[i] for x in of]], pa.list_(pa.int64())) for i in range(3))],
                names=["n", "starts", "body", "tids", "at", "lo"],
            )

        for batch in batches:
            for tid, text, found in zip(batch.column("tid").to_pylist(), batch.column("body"), batch.column("runs").to_pylist()):
                text = memoryview(text.as_buffer())
                found = sorted((r["lo"], r["hi"]) for r in found)
                i = 0
                while i < len(found):
                    lo, j = found[i][0], i
                    while j + 1 < len(found) and found[j + 1][0] <= found[j][1] + length and found[j][1] - lo < BLOCK:
                        j += 1
                    of.append((tid, size, lo))
                    starts += [np.arange(a, b + 1) + (size - lo) for a, b in found[i : j + 1]]
                    body.append(bytes(text[lo : found[j][1] + length]))
                    size += len(body[-1])
                    i = j + 1
                    if size >= BLOCK:
                        yield close()
                        body, starts, of, size = [], [], [], 0
        if of:
            yield close()

    by_text = wanted.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))  # runs of one text
    distinct = texts.groupBy("tid").agg(F.first("body").alias("body"))
    out = distinct.join(by_text, "tid").mapInArrow(run, "n long, starts binary, body binary, tids array<long>, at array<long>, lo array<long>")
    return out.withColumn("blk", F.monotonically_increasing_id())


# --- one block -----------------------------------------------------------------------------------------------------


def levels_of(length: int) -> int:
    """How many times triples are named until a name stands for ``length`` bytes."""
    levels, depth = 1, 3 * UNIT
    while depth < length:
        levels, depth = levels + 1, 3 * depth
    return levels


class Level:
    """The positions of a block's string at one level: ``u`` symbols a unit, ``c`` periods of three units."""

    def __init__(self, size: int, level: int):
        self.u = UNIT if level == 0 else 1
        self.c = -(-size // (3 * self.u))
        self.samples = 2 * self.u * self.c

    def position(self, index: np.ndarray) -> np.ndarray:
        """Of sample numbers (positions of the next level's string): class 1 before class 2, residue by residue."""
        return index % self.c * (3 * self.u) + self.u + index // self.c

    def index(self, position: np.ndarray) -> np.ndarray:
        """The sample number of positions of classes 1 and 2; beyond the end, the last number."""
        period, residue = np.divmod(position, 3 * self.u)
        return np.where(period < self.c, (residue - self.u) * self.c + period, self.samples - 1)

    def kind(self, position: np.ndarray) -> np.ndarray:
        return position // self.u % 3


def plan(size: int, starts: np.ndarray, levels: int) -> list[tuple[Level, np.ndarray]]:
    """Each level with the positions whose rank is asked for; the last entry has the sample numbers of the last level."""
    out, asked = [], starts.astype(np.int64)
    for i in range(levels):
        level = Level(size, i)
        out.append((level, asked))
        near = np.concatenate([asked, asked + level.u, asked + 2 * level.u])
        flags = np.zeros(level.samples, bool)
        flags[level.index(near[level.kind(near) > 0])] = True
        asked, size = np.flatnonzero(flags), level.samples
    return [*out, (None, asked)]


class Symbols:
    """A block's string: bytes at level 0, names above; zero beyond the end."""

    def __init__(self, data: bytes, level: int):
        if level == 0:
            self.size, padded = len(data), data + bytes(64)
            self.eight = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
        else:
            self.size = int.from_bytes(data[:8], "little")
            self.names = np.concatenate([*unpack(data[8:], self.size, ["<u8"]), np.zeros(8, np.uint64)])
        self.level = level

    @staticmethod
    def stored(names: np.ndarray) -> bytes:
        return len(names).to_bytes(8, "little") + pack([names])

    def _at(self, position: np.ndarray) -> np.ndarray:
        source = self.names if self.level else self.eight
        return source[np.minimum(position, len(source) - 1)].astype(np.uint64)

    def first(self, position: np.ndarray) -> np.ndarray:
        """What ranges are bounded by: eight bytes, or a name."""
        return self._at(position)

    def triple(self, position: np.ndarray) -> list[np.ndarray]:
        if self.level:
            return [self._at(position + i) for i in range(3)]
        return [self._at(position), self._at(position + 8) >> np.uint64(8)]

    def unit(self, position: np.ndarray) -> np.ndarray:
        return self._at(position) if self.level else self._at(position) >> np.uint64(24)


def window_digests(data: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each start; only neighbours in suffix order are ever compared by it."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    out = np.zeros(len(starts), np.uint64)
    ends = [*range(0, length - 8, 8), length - 8]
    with np.errstate(over="ignore"):
        for i in ends:
            out = mix64(out + eight[starts + i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


# --- ranges --------------------------------------------------------------------------------------------------------


_DEALT = "part long, blk long, n long, data binary"
_BACK = "blk long, n long, data binary"


def _dealt(blk: int, bounds: np.ndarray, first: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of packed columns, one for each range of ``first`` that the block has something of."""
    part = np.searchsorted(bounds, first, side="right")
    order = np.argsort(part, kind="stable")
    columns = [c[order] for c in columns]
    parts, begin = np.unique(part[order], return_index=True)
    ends = [*begin[1:].tolist(), len(part)]
    rows = [(int(p), b - a, pack([c[a:b] for c in columns])) for p, a, b in zip(parts, begin.tolist(), ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([blk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
        names=["part", "blk", "n", "data"],
    )


def _gathered(t: pa.Table, kinds: list[str]) -> tuple[list[np.ndarray], list[int]]:
    """The columns of all rows of a range one after another, and the rows' sizes."""
    sizes = t.column("n").to_pylist()
    parts = [unpack(d.as_buffer(), n, kinds) for d, n in zip(t.column("data"), sizes)]
    return [np.concatenate(c) for c in zip(*parts)], sizes


def _returned(t: pa.Table, sizes: list[int], columns: list[np.ndarray]) -> pa.Table:
    ends = np.cumsum(sizes).tolist()
    data = [pack([c[e - n : e] for c in columns]) for n, e in zip(sizes, ends)]
    return pa.table({"blk": t.column("blk"), "n": t.column("n"), "data": pa.array(data, pa.binary())})


def _name(t: pa.Table, kinds: list[str]) -> pa.Table:
    """Names of a range's triples, in their order; equal triples have equal names."""
    columns, sizes = _gathered(t, kinds)
    index, keys = columns[0], columns[1:]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    name = np.empty(len(order), np.uint64)
    name[order] = (np.uint64(t.column("part")[0].as_py()) << np.uint64(32)) + np.cumsum(new).astype(np.uint64) + np.uint64(1)
    return _returned(t, sizes, [index, name])


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Numbers in the order of the keys, equal for equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def merged_order(kind: np.ndarray, a: np.ndarray, b: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The order of suffixes of all three classes.

    ``a`` and ``b`` are a suffix's first two units.  ``near`` is the rank after one unit (classes 0 and 1), or the own rank
    (class 2); ``far`` the rank after two units (classes 0 and 2), or the own rank (class 1).
    """
    at = [np.flatnonzero(kind == k) for k in range(3)]
    own = np.concatenate([far[at[1]], near[at[2]]])
    sample = np.concatenate(at[1:])
    place = np.empty(len(kind), np.int64)
    place[sample[np.argsort(own, kind="stable")]] = np.arange(len(sample))
    place[at[0][np.lexsort((near[at[0]], a[at[0]]))]] = np.arange(len(at[0]))
    for k, keys in ((1, (a, near)), (2, (a, b, far))):
        both = np.concatenate([at[0], at[k]])
        dense = _dense(*(key[both] for key in keys))
        mine, other = dense[: len(at[0])], dense[len(at[0]) :]
        place[at[0]] += np.searchsorted(np.sort(other), mine, side="left")
        place[at[k]] += np.searchsorted(np.sort(mine), other, side="right")
    return np.argsort(place, kind="stable")


_MERGED = ["<u4", "u1", "<u8", "<u8", "<u8", "<u8", "<u8"]


def _merge(t: pa.Table) -> pa.Table:
    """Ranks of a range's suffixes."""
    (at, kind, a, b, near, far, _), sizes = _gathered(t, _MERGED)
    rank = np.empty(len(at), np.uint64)
    rank[merged_order(kind, a, b, near, far)] = (np.uint64(t.column("part")[0].as_py()) << np.uint64(32)) + np.arange(1, len(at) + 1, dtype=np.uint64)
    return _returned(t, sizes, [at, rank])


def _compare(t: pa.Table) -> pa.Table:
    """Whether a range's suffixes agree with a neighbour in their first bytes."""
    (at, kind, a, b, near, far, digest), sizes = _gathered(t, _MERGED)
    order = merged_order(kind, a, b, near, far)
    same = digest[order][1:] == digest[order][:-1]
    found = np.zeros(len(at), "u1")
    found[order] = np.r_[same, False] | np.r_[False, same]
    return _returned(t, sizes, [at, found])


# --- levels --------------------------------------------------------------------------------------------------------


def _bounds(strings: DataFrame, level: int) -> np.ndarray:
    """Bounds of ranges of about ``PART`` samples, from ``SAMPLES`` symbols of each block."""

    def run(batches):
        for batch in batches:
            for data in batch.column("body"):
                symbols = Symbols(data.as_buffer().to_pybytes(), level)
                shape = Level(symbols.size, level)
                first = symbols.first(shape.position(np.linspace(0, shape.samples - 1, SAMPLES).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([shape.samples]), pa.array([first.tobytes()])], names=["n", "data"])

    rows = strings.select("body").mapInArrow(run, "n long, data binary").collect()
    if not rows:
        return np.zeros(0, np.uint64)
    sample = np.sort(np.concatenate([np.frombuffer(r["data"], np.uint64) for r in rows]))
    parts = -(-sum(r["n"] for r in rows) // PART)
    return np.unique(sample[[len(sample) * i // parts for i in range(1, parts)]])


def _up(strings: DataFrame, level: int, levels: int, bounds: np.ndarray) -> DataFrame:
    """(blk, n, data) with sample numbers and names; at the last level only of those that are asked for."""
    kinds = ["<u4", *["<u8"] * (3 if level else 2)]

    def deal(batches):
        for batch in batches:
            for blk, n, starts, data in zip(batch.column("blk").to_pylist(), batch.column("size").to_pylist(), batch.column("starts"), batch.column("body")):
                symbols = Symbols(data.as_buffer().to_pybytes(), level)
                if level == levels - 1:
                    planned = plan(n, np.frombuffer(starts.as_buffer(), np.uint32), levels)
                    shape, index = planned[level][0], planned[levels][1]
                else:
                    shape = Level(symbols.size, level)
                    index = np.arange(shape.samples)
                keys = symbols.triple(shape.position(index))
                yield _dealt(blk, bounds, keys[0], [index.astype(np.uint32), *keys])

    dealt = strings.select("blk", "size", "starts", "body").mapInArrow(deal, _DEALT)
    return dealt.groupBy("part").applyInArrow(lambda t: _name(t, kinds), _BACK)


def _with_rows(packed: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks and the packed rows that came back to them, under one schema, to be grouped by block."""
    none = {c: F.lit(None).cast(packed.schema[c].dataType) for c in columns}
    return packed.select("blk", *columns, F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("data")).unionByName(
        rows.select("blk", "n", "data").withColumns(none)
    )


def _split_rows(t: pa.Table) -> tuple[dict, list[tuple[bytes, int]]]:
    """The block's own row, and what came back to it."""
    rows = t.to_pylist()
    own = next(r for r in rows if r["data"] is None)
    return own, [(r["data"], r["n"]) for r in rows if r["data"] is not None]


def _names_string(strings: DataFrame, named: DataFrame) -> DataFrame:
    """The next level's strings: (blk, size, starts, body)."""

    def build(t: pa.Table) -> pa.Table:
        own, rows = _split_rows(t)
        names = np.zeros(sum(n for _, n in rows), np.uint64)
        for data, n in rows:
            index, name = unpack(data, n, ["<u4", "<u8"])
            names[index] = name
        return pa.table({"blk": [own["blk"]], "size": [own["size"]], "starts": [own["starts"]], "body": [Symbols.stored(names)]})

    return _with_rows(strings, named, ["size", "starts"]).groupBy("blk").applyInArrow(build, "blk long, size long, starts binary, body binary")


def _down(strings: DataFrame, ranks: DataFrame, level: int, levels: int, bounds: np.ndarray, length: int) -> DataFrame:
    """(blk, n, data) with positions of this level and their ranks, or at level 0 whether they are repeated."""

    def deal(t: pa.Table) -> pa.Table:
        own, rows = _split_rows(t)
        shape, asked = plan(own["size"], np.frombuffer(own["starts"], np.uint32), levels)[level]
        rank = np.zeros(shape.samples, np.uint64)
        for data, n in rows:
            index, value = unpack(data, n, ["<u4", "<u8"])
            rank[index] = value
        symbols, kind = Symbols(own["body"], level), shape.kind(asked)
        ranked = lambda steps: rank[shape.index(asked + steps * shape.u)]
        near = np.where(kind == 2, ranked(0), ranked(1))
        far = np.where(kind == 1, ranked(0), ranked(2))
        digest = window_digests(own["body"], asked, length) if level == 0 else np.zeros(len(asked), np.uint64)
        columns = [asked.astype(np.uint32), kind.astype("u1"), symbols.unit(asked), symbols.unit(asked + shape.u), near, far, digest]
        return pa.Table.from_batches([_dealt(own["blk"], bounds, symbols.first(asked), columns)])

    dealt = _with_rows(strings, ranks, ["size", "starts", "body"]).groupBy("blk").applyInArrow(deal, _DEALT)
    return dealt.groupBy("part").applyInArrow(_merge if level else _compare, _BACK)


def repeated_windows(packed: DataFrame, length: int) -> DataFrame:
    """(blk, n, data) with window starts of the blocks and whether they are repeated, by the suffix array of all blocks."""
    levels = levels_of(length)
    strings, bounds = [packed.withColumnRenamed("n", "size")], []
    for level in range(levels):
        bounds.append(_bounds(strings[-1], level))
        named = _up(strings[-1], level, levels, bounds[-1])
        if level < levels - 1:
            strings.append(materialize(_names_string(strings[-1], named), f"names-{level + 1}", "zstd"))
    ranks = materialize(named, f"ranks-{levels}")
    for level in reversed(range(levels)):
        lower = materialize(_down(strings[level], ranks, level, levels, bounds[level], length), f"ranks-{level}")
        discard(ranks, *strings[level:][: level > 0])
        ranks = lower
    return ranks


def _places(packed: DataFrame, found: DataFrame) -> DataFrame:
    """(tid, lo, hi): the repeated windows' starts in their texts, neighbours as one row."""

    def place(t: pa.Table) -> pa.Table:
        own, rows = _split_rows(t)
        starts = np.concatenate([at[same > 0] for at, same in (unpack(data, n, ["<u4", "u1"]) for data, n in rows)] or [np.zeros(0, np.uint32)]).astype(np.int64)
        starts.sort()
        at, tids, lo = (np.array(own[c], np.int64) for c in ("at", "tids", "lo"))
        i = np.searchsorted(at, starts, side="right") - 1
        begin = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(i) != 0)]) if len(starts) else np.zeros(0, np.int64)
        end = np.r_[begin[1:], len(starts)][: len(begin)] - 1
        shift = lo[i] - at[i]
        return pa.table({"tid": tids[i[begin]], "lo": starts[begin] + shift[begin], "hi": starts[end] + shift[end]})

    return _with_rows(packed, found, ["tids", "at", "lo"]).groupBy("blk").applyInArrow(place, "tid long, lo long, hi long")


def _spans(runs: Column, length: int) -> Column:
    """Maximal removed spans (start, stop) of sorted runs of window starts."""
    span = lambda start, stop: F.struct(start.alias("start"), stop.alias("stop"))

    def add(spans: Column, run: Column) -> Column:
        last = F.element_at(spans, -1)
        return F.when((F.size(spans) > 0) & (run["lo"] <= last["stop"]), F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(span(last["start"], F.greatest(last["stop"], run["hi"] + length))))).otherwise(
            F.concat(spans, F.array(span(run["lo"], run["hi"] + length)))
        )

    return F.aggregate(F.array_sort(runs), F.array().cast("array<struct<start:bigint,stop:bigint>>"), add)


def _text_id(body: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), body)


def text_ids(bodies: DataFrame) -> tuple[int, DataFrame]:
    """A seed that gives each distinct text a hash of its own, and (tid, copies, stop): how often it occurs, and its length."""
    for seed in itertools.count():
        same = bodies.groupBy(_text_id(F.col("body"), seed).alias("tid")).agg(
            F.count(F.lit(1)).alias("copies"), F.max(F.length("body")).cast("long").alias("stop"), F.min(F.md5("body")).alias("least"), F.max(F.md5("body")).alias("most")
        )
        ids = materialize(same.select("tid", "copies", "stop", (F.col("least") != F.col("most")).alias("clash")), "text-ids", "zstd")
        if ids.filter("clash").isEmpty():
            return seed, ids.drop("clash")
        discard(ids)


def repeated_spans(docs: DataFrame, length: int = LENGTH, text: str = "text") -> tuple[int, DataFrame]:
    """(tid, spans): for each distinct text with a repeated string its maximal spans of bytes to be removed; and the seed of tid."""
    bound_batches(docs.sparkSession)
    bodies = docs.select(text_or_empty(text).cast("binary").alias("body")).filter(F.length("body") >= length)
    seed, ids = text_ids(bodies)
    texts = bodies.select(_text_id(F.col("body"), seed).alias("tid"), "body")
    every = materialize(runs(texts, length), "runs", "zstd")
    repeated = repeated_runs(every)
    discard(every)
    packed = materialize(blocks(texts, repeated.filter("sort"), length), "blocks", "zstd")
    release(docs.sparkSession)
    found = repeated_windows(packed, length)
    places = materialize(_places(packed, found).unionByName(repeated.filter("full").select("tid", "lo", "hi")), "places", "zstd")
    discard(packed, found, repeated)
    by_text = places.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), "stop"))
    spans = ids.join(by_text, "tid", "left").select("tid", F.when(F.col("copies") > 1, all_of).otherwise(_spans(F.col("found"), length)).alias("spans")).filter(F.size("spans") > 0)
    out = materialize(spans, "spans", "zstd")
    discard(places)
    return seed, out


@F.udf(BinaryType(), useArrow=True)
def _cut(body, spans):
    if body is None:
        return None
    ends = [0, *(x for s in spans for x in (s["start"], s["stop"])), len(body)]
    return b"".join(body[a:b] for a, b in zip(ends[::2], ends[1::2]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", kept: str = "kept", spans: str = "removed") -> DataFrame:
    """``docs`` with ``kept``, the UTF-8 bytes of the text without repeated strings, and ``removed``, their maximal spans.

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in the same or another row;
    strings overlap, never cross rows, and are judged on the input.  Null texts count as empty; what is kept may end within a
    character.  Rows that repeat a text of ``length`` bytes or more lose all of it, shorter texts nothing.  Existing columns
    of the two names are replaced, others are kept; an empty table gives an empty result.
    """
    if length < 16:
        raise ValueError("strings of 16 bytes or more can be looked for")
    docs = docs.drop(*(c for c in (kept, spans) if c.lower() != text.lower()))
    body = text_or_empty(text).cast("binary")
    tid, found = free_name(docs, "tid"), free_name(docs, "found")
    seed, spans_of = repeated_spans(docs, length, text)
    of = spans_of.select(F.col("tid").alias(tid), F.col("spans").alias(found))
    both = docs.withColumn(tid, _text_id(body, seed)).join(of, tid, "left")
    has = F.col(found).isNotNull() & (F.length(body) >= length)
    cut = _cut(F.when(has, body), F.col(found))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return both.withColumns({kept: F.when(has, cut).otherwise(body), spans: F.coalesce(F.col(found), none)}).drop(tid, found)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return done.select(
        "doc_id", F.length(text_or_empty().cast("binary")).cast("long").alias("n_bytes"), n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
