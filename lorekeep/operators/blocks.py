"""Pairs of rows by the words that their sets share, counted block by block.

The rows of a group are dealt out in blocks, and every two blocks meet in one task, which adds up lists of word numbers or compares
bit maps of sets: no pair that shares a word is a row before it has shared enough.  Small groups share a block, large ones have many,
so that a task's memory is bounded by the block whatever the groups are.  A row is sent once for each block that it meets; ``most``
bounds what is sent at a time.
"""

from __future__ import annotations

import gc
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from ..session import release, written

#: What a row counts in a block at least; meetings by a word that are counted at a time (of one row there may be more).
LEAST, MEETINGS = 64, 2_000_000
#: Classes of sizes: this many for each power of e.
CLASSES = 8
#: Numbers in bit maps that are multiplied at a time; groups of fewer pairs than this count meetings instead.
MAP, FEW = 1 << 22, 1 << 14


def _cut(weights: dict[int, int], block: int) -> tuple[dict[int, tuple[float, float]], np.ndarray, np.ndarray, float]:
    """Where each class of sizes begins and how far it reaches, in blocks; least and largest size of each block; a block's weight."""
    total = sum(weights.values())
    n = max(1, -(-total // block))
    spans, low, high, at = {}, np.full(n, np.inf), np.zeros(n), 0
    for c in sorted(weights):
        spans[c] = (at * n / total, weights[c] * n / total)
        at += weights[c]
        held = slice(min(n - 1, int(spans[c][0])), min(n - 1, int(at * n / total)) + 1)
        low[held], high[held] = np.minimum(low[held], math.exp(c / CLASSES) * (1 - 1e-6)), np.maximum(high[held], math.exp((c + 1) / CLASSES) * (1 + 1e-6))
    return spans, low, high, total / n


def _passes(strips: list[tuple], most: float) -> list[list[tuple]]:
    """Strips (..., what they send) in passes that send ``most`` each, or one strip."""
    passes, filled = [[]], 0.0
    for strip in strips:
        if passes[-1] and filled + strip[-1] > most:
            passes.append([])
            filled = 0.0
        passes[-1].append(strip)
        filled += strip[-1]
    return passes


def meet(left: DataFrame, right: DataFrame | None, block: int, run: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], schema: StructType, low: float = 0.0, most: float | None = None, streamed: bool = True) -> DataFrame:
    """What ``run`` yields of every two blocks of equal ``g``, in columns of ``schema``, and same: whether a block met itself (``run`` then gets one table twice).

    ``left`` and ``right`` have id, g, size (words), and what ``run`` needs.  Without ``right`` the blocks of ``left`` meet each
    other, two different ones once.  A block has about ``block`` words, and with ``low`` rows of about a size: blocks whose sizes all
    differ by more than that ratio do not meet.  With ``most``, blocks meet in passes that send about ``most`` times all rows
    each, or what one block meets, and what a pass finds is written before the next; else all is sent at once.  What ``run`` yields leaves
    the task as it comes, or with ``streamed`` off as one table of two cogrouped sides, which need not have equal columns.
    """
    spark, alone = left.sparkSession, right is None
    group = lambda rows: rows.withColumns({"k": F.xxhash64("g"), "c": F.floor(F.log("size") * CLASSES).cast("int") if low else F.lit(0)})
    weigh = lambda rows, side: group(rows).groupBy("k", "c").agg(F.sum(F.greatest("size", F.lit(LEAST))).alias("w")).withColumn("right", F.lit(side))
    weights = weigh(left, False) if alone else weigh(left, False).unionByName(weigh(right, True))
    sums = [F.sum(F.when(F.col("right") == side, F.col("w")).otherwise(0)).alias(name) for side, name in ((False, "wl"), (True, "wr"))]
    groups = weights.groupBy("k").agg(*sums) if alone else weights.groupBy("k").agg(*sums).filter("wl > 0 and wr > 0")
    small = F.greatest("wl", "wr") <= block
    total = groups.filter(small).agg(F.sum(F.greatest("wl", "wr"))).first()[0] or 0
    buckets = max(1, -(-4 * total // block))
    of = defaultdict(lambda: ({}, {}))
    for r in weights.join(groups.filter(~small).select("k"), "k").collect():  # few groups: each fills a block
        of[r["k"]][r["right"]][r["c"]] = r["w"]

    spans, strips, all_ = ([], []), [], total * (1 if alone else 2)
    for k, (wl, wr) in sorted(of.items()):
        mine = _cut(wl, block)
        theirs = mine if alone else _cut(wr, block)
        for side, cut in zip(spans, (mine, theirs)):
            side.extend((k, c, *span) for c, span in cut[0].items())
        all_ += sum(wl.values()) + sum(wr.values())
        for i in range(len(mine[1])):
            near = np.flatnonzero((mine[2][i] >= low * theirs[1]) & (theirs[2] >= low * mine[1][i]))
            near = near[near >= i] if alone else near
            if len(near):
                strips.append((k, i, int(near[0]), int(near[-1]), len(near) * (mine[3] + theirs[3])))
    spans = [spark.createDataFrame(s, "k long, c int, start double, share double") for s in spans]

    def placed(rows: DataFrame, side: bool, ranges: dict, first: bool) -> DataFrame:
        """Rows in the cells where their block is among ``ranges``; those of small groups with the first pass."""
        table = F.broadcast(spark.createDataFrame([(*at, *r) for at, r in ranges.items()], "k long, at int, from int, to int"))
        within = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
        keyed = group(rows).join(F.broadcast(spans[side]), ["k", "c"], "left")
        # the last block may end a hair beyond what the classes sum up to
        last = F.broadcast(spark.createDataFrame([(k, n) for k, n in ends[side].items()], "k long, end int"))
        keyed = keyed.join(last, "k", "left").withColumn("at", F.least(F.floor(F.col("start") + within * F.col("share")).cast("int"), F.col("end")))
        keyed = keyed.join(table, ["k", "at"], "left")
        alone_in_bucket = F.col("start").isNull() & F.lit(first and not (alone and side))
        keyed = keyed.filter(F.col("from").isNotNull() | alone_in_bucket)
        keyed = keyed.withColumns({"home": F.when(F.col("start").isNull(), F.pmod("k", F.lit(buckets))).otherwise(F.col("k")), **{n: F.coalesce(n, F.lit(0)) for n in ("at", "from", "to")}})
        own, other = ("j", "i") if side else ("i", "j")
        sent = keyed.withColumn(other, F.explode(F.sequence("from", "to"))).withColumnRenamed("at", own).withColumn("right", F.lit(side))
        return sent.drop("k", "c", "start", "share", "end", "from", "to")

    ends = ({}, {})
    for k, (wl, wr) in of.items():
        ends[0][k] = ends[1][k] = max(1, -(-sum(wl.values()) // block)) - 1
        if not alone:
            ends[1][k] = max(1, -(-sum(wr.values()) // block)) - 1

    result = StructType([*schema.fields, StructField("same", BooleanType())])

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        same = alone and key[1].as_py() == key[2].as_py()
        a = rows if same else rows.filter(pc.invert(rows.column("right")))
        b = rows if same else rows.filter(rows.column("right"))
        del rows
        if len(a) and len(b):
            for out in run(a, b):
                yield from out.append_column("same", pa.array(np.full(len(out), same))).combine_chunks().to_batches()

    def whole(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        same = alone and key[1].as_py() == key[2].as_py()
        out = list(run(a, a if same else b)) if len(a) and (same or len(b)) else []
        return pa.concat_tables([t.append_column("same", pa.array(np.full(len(t), same))) for t in out]) if out else to_arrow_schema(result).empty_table()

    found = []
    passes = _passes(strips, math.inf if most is None else most * all_)
    for p, chosen in enumerate(passes):
        lefts, rights = {(k, i): (lo, hi) for k, i, lo, hi, _ in chosen}, {}
        for k, i, lo, hi, _ in chosen:
            for j in range(max(lo, i + 1) if alone else lo, hi + 1):
                rights[k, j] = (min(i, rights.get((k, j), (i,))[0]), i)
        cells = sum(hi - lo + 1 for _, _, lo, hi, _ in chosen) + (buckets if p == 0 else 0)
        # a cell is much work of few rows: none are put together
        dealt = lambda rows: rows.repartition(min(1024, 2 * cells), "home", "i", "j")
        ours = placed(left, False, lefts, p == 0)
        theirs = placed(left if alone else right, True, rights, p == 0)
        if streamed:
            met = dealt(ours.unionByName(theirs) if rights or not alone else ours).groupBy("home", "i", "j").applyInArrow(cell, result)
        else:
            theirs = theirs.select(*(F.col(c).alias(c) for c in theirs.columns))  # columns of its own: a side may meet itself
            met = dealt(ours).groupBy("home", "i", "j").cogroup(dealt(theirs).groupBy("home", "i", "j")).applyInArrow(whole, result)
        if len(passes) == 1:
            return met
        found.append(written(met, "met"))
        del ours, theirs, dealt, met
        gc.collect()
        release(spark)
    return reduce(DataFrame.unionByName, found)


def once(pairs: DataFrame) -> DataFrame:
    """``pairs`` (id_a, id_b, same) with id_a < id_b, each once."""
    kept = pairs.filter((F.col("id_a") != F.col("id_b")) & (~F.col("same") | (F.col("id_a") < F.col("id_b")))).drop("same")
    return kept.withColumns({"id_a": F.least("id_a", "id_b"), "id_b": F.greatest("id_a", "id_b")})


def _numbers(a: pa.Table, b: pa.Table, words: str) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Offsets, group of each row and number of each word of both sides, and how many words there are.  Sets are arrays, or words between blanks."""
    sides = [t.select(["g", words]).combine_chunks() for t in ((a,) if b is a else (a, b))]
    lists = [t.column(words).combine_chunks() for t in sides]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    lists = [pc.split_pattern(x, " ") if pa.types.is_string(x.type) else x for x in lists]
    groups = pa.chunked_array([c for t in sides for c in t.column("g").chunks]).combine_chunks().dictionary_encode("encode")
    values = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode("encode")
    which, word = groups.indices.to_numpy(), values.indices.to_numpy()
    out, row, at = [], 0, 0
    for x in lists:
        sizes = np.diff(x.offsets.to_numpy())
        n, rows = int(sizes.sum()), len(x)
        out.append((np.concatenate(([0], np.cumsum(sizes))), which[row : row + rows], word[at : at + n]))
        row, at = row + rows, at + n
    return out * 2 if b is a else out, len(values.dictionary)


def numbered(a: pa.Table, b: pa.Table, words: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Offsets and numbers of the words of both sides: equal ones for equal words of equal ``g``."""
    sides, n = _numbers(a, b, words)
    return [(starts, _within(starts, g, word, n)) for starts, g, word in sides]


def _within(starts: np.ndarray, g: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Numbers of words that differ between groups."""
    small = (int(g.max(initial=0)) + 1) * (n + 1) < 1 << 31
    return np.repeat(g, np.diff(starts)).astype(np.int32 if small else np.int64) * (n + 1) + word


def shared(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], least: Callable[[int, int], int] = lambda a, b: 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In parts, the places i, j and the count of the pairs that share words; of rows a to b of the left side, pairs under ``least(a, b)`` may be left out."""
    (starts, words), (ends, others) = left, right
    rows, across = len(starts) - 1, len(ends) - 1
    order = np.argsort(others, kind="stable")
    owner, sorted_ = np.repeat(np.arange(across, dtype=np.int32), np.diff(ends))[order], others[order]
    del order
    each, back = np.unique(words, return_inverse=True)
    first = np.searchsorted(sorted_, each)
    first, n = first[back], (np.searchsorted(sorted_, each, "right") - first)[back]
    met = np.concatenate(([0], np.cumsum(n)))
    by_row = met[starts]  # meetings before each row
    a = 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(by_row, by_row[a] + MEETINGS, "right")) - 1)
        s, e = starts[a], starts[b]
        total, pairs = int(by_row[b] - by_row[a]), (b - a) * across
        if total:
            place = np.arange(total) + np.repeat(first[s:e] - (met[s:e] - met[s]), n[s:e])
            pair = np.repeat(np.arange(b - a) * across, np.diff(by_row[a : b + 1])) + owner[place]
            if pairs <= 8 * total:
                count = np.bincount(pair, minlength=pairs)
                hit = np.flatnonzero(count >= least(a, b))
                count = count[hit]
            else:  # most pairs share nothing
                hit, count = np.unique(pair, return_counts=True)
            yield a + hit // across, hit % across, count
        a = b


def alike(a: pa.Table, b: pa.Table, words: str, low: float, frequent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In parts, the places i, j and the exact count of shared words of the pairs of equal ``g`` whose Jaccard is ``low`` or more (and of few below).

    Both sides are sorted by ``g`` and size.  Of one table with itself each pair comes once.  Pairs of large groups are first compared by
    bit maps, whose bits tell odd from even numbers of words: sets that differ in d words differ in d bits at most.  The
    ``frequent`` most frequent words are dealt over the bits one after the other.
    """
    same = b is a
    sides, n = _numbers(a, b, words)
    count = sum(np.bincount(word, minlength=n) for _, _, word in sides)
    bit = np.argsort(np.argsort(-np.where(count >= np.sort(count)[-min(frequent, n)], count, 0), kind="stable"))
    spans = [{g[x]: (x, y) for x, y in zip(e[:-1], e[1:])} for _, g, _ in sides for e in [np.r_[0, np.flatnonzero(np.diff(g)) + 1, len(g)]]]
    few = [np.zeros(len(g), bool) for _, g, _ in sides]
    for g, (x, y) in spans[0].items():
        u, v = spans[1].get(g, (0, 0))
        if (y - x) * (v - u) > FEW:
            yield from _mapped(sides, (x, y), (u, v), bit, n, low, same)
        elif v > u:
            few[0][x:y], few[1][u:v] = True, True
    if few[0].any():
        kept = [np.flatnonzero(f) for f in few]
        lists = []
        for (starts, g, word), f in zip(sides, few):
            sizes = np.diff(starts)
            lists.append((np.concatenate(([0], np.cumsum(sizes[f]))), (np.repeat(g, sizes).astype(np.int64) * (n + 1) + word)[np.repeat(f, sizes)]))
        for i, j, c in shared(*lists):
            i, j = kept[0][i], kept[1][j]
            hit = _enough(np.diff(sides[0][0])[i], np.diff(sides[1][0])[j], c, low) & (~np.bool_(same) | (j < i))
            yield i[hit], j[hit], c[hit]


def _enough(m: np.ndarray, n: np.ndarray, c: np.ndarray, low: float) -> np.ndarray:
    return c * (1 + low) >= (m + n) * low - 1e-6


def _mapped(sides: list, left: tuple[int, int], right: tuple[int, int], bit: np.ndarray, n: int, low: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``alike`` of the rows ``left`` and ``right`` of one group, by products of their bit maps."""
    sizes = [np.diff(starts) for starts, _, _ in sides]
    width = [np.exp2(np.ceil(np.log2(np.maximum(64, 6 * (1 - low) * s)))).astype(int) for s in sizes]
    share = 2 * (1 - low) / (1 + low)
    marked = np.zeros(n, bool)

    def maps(side: int, x: int, y: int, bits: int) -> np.ndarray:
        starts, _, word = sides[side]
        place = np.repeat(np.arange(y - x) * bits, sizes[side][x:y]) + bit[word[starts[x] : starts[y]]] % bits
        out = np.empty((y - x, bits + 2), np.float32)
        out[:, :bits] = 1 - 2 * (np.bincount(place, minlength=(y - x) * bits) & 1).reshape(y - x, bits)
        out[:, bits + side], out[:, bits + 1 - side] = share * sizes[side][x:y], 1  # added up: what two sets may differ at most
        return out

    def counted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Shared words of pairs, which come by i."""
        c = np.empty(len(i), np.int64)
        edges = np.r_[np.flatnonzero(np.r_[True, np.diff(i) != 0]), len(i)]
        for e, f in zip(edges[:-1], edges[1:]):
            words = sides[0][2][sides[0][0][i[e]] : sides[0][0][i[e] + 1]]
            marked[words] = True
            for s in range(e, f, 1024):
                of = j[s : min(f, s + 1024)]
                ends = np.cumsum(sizes[1][of])
                place = np.arange(ends[-1]) + np.repeat(sides[1][0][of] - ends + sizes[1][of], sizes[1][of])
                c[s : s + len(of)] = np.add.reduceat(marked[sides[1][2][place]], ends - sizes[1][of], dtype=np.int64)
            marked[words] = False
        return c

    def tiles(a: tuple[int, int], b: tuple[int, int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, MAP // bits)
        for u in range(b[0], b[1], min(step, 4096)):
            v, mb = min(b[1], u + min(step, 4096)), None
            for x in range(a[0], a[1], min(step, 1024)):
                y = min(a[1], x + min(step, 1024))
                if (same and u >= y) or sizes[0][y - 1] < low * sizes[1][u] or sizes[1][v - 1] < low * sizes[0][x]:
                    continue
                mb = maps(1, u, v, bits) if mb is None else mb
                i, j = np.divmod(np.flatnonzero(maps(0, x, y, bits) @ mb.T >= bits - 0.5), v - u)
                i, j = i + x, j + u
                m, o = sizes[0][i], sizes[1][j]
                hit = (np.minimum(m, o) >= np.maximum(m, o) * low - 1e-9) & (~np.bool_(same) | (j < i))
                i, j = i[hit], j[hit]
                if len(i):
                    c = counted(i, j)
                    hit = _enough(sizes[0][i], sizes[1][j], c, low)
                    yield i[hit], j[hit], c[hit]

    for bits in np.unique(np.concatenate([width[0][slice(*left)], width[1][slice(*right)]])):
        # rows are sorted by size: those of this width, and shorter ones of the other side
        a, b = ([r[0] + int(np.searchsorted(w[slice(*r)], bits, how)) for how in ("left", "right")] for w, r in zip(width, (left, right)))
        yield from tiles((a[0], a[1]), (right[0], b[1]), int(bits))
        if not same:
            yield from tiles((left[0], a[0]), (b[0], b[1]), int(bits))
