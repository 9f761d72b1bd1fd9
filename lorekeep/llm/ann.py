"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: every unit vector is turned by a seeded random rotation and kept as the signs of its coordinates (packed
bits) with two scalars: the inner product of the vector and its code, which makes the estimate unbiased, and the
half-width of the error bound.  Search: estimates come from the unpacked bits of a block and the rotated queries;
a vector whose upper bound stays under the best exact scores found so far is never touched again, all others are
reranked by their exact cosine in double precision.

The index is never shuffled: queries go to it, in passes of at most ``QUERY_BYTES``, and a task keeps the best k of
each query over all its blocks, which also is the floor that later blocks must reach.  A task's result is k rows a
query, whatever it has read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

#: Vectors that are estimated together, queries estimated together, and pairs reranked together.
BLOCK_ROWS, QUERY_ROWS, PAIRS = 4096, 256, 1 << 14
#: Bytes of the queries of one pass over the index, which are sent to every worker.
QUERY_BYTES = 16 << 20
#: Half-widths of the error bound: a larger value reranks more and misses less.
EPSILON = 3.0


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, correction (inner product of vector and code) and error half-width of each row."""
    dim = vectors.shape[1]
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    turned = unit @ rotation(dim, seed).T
    correction = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    error = EPSILON * np.sqrt(np.maximum(0, 1 - correction**2)) / correction / np.sqrt(max(1, dim - 1))
    return np.packbits(turned > 0, axis=1), correction, error


def ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products summed from left to right, so that equal rows give equal bits anywhere."""
    return np.cumsum(a * b, axis=-1)[..., -1]


class Search:
    """The best ``k`` of each query so far, by exact cosine and then by smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, seed: int = 7):
        self.ids, self.queries, self.k, self.dim, self.seed = ids, queries, k, queries.shape[1], seed
        self.norms = np.sqrt(ordered_dot(queries, queries))
        turned = (queries / np.abs(queries).max(axis=1, keepdims=True)) @ rotation(self.dim, seed).T
        self.turned = (turned / np.sqrt((turned**2).sum(axis=1, keepdims=True))).astype(np.float32)
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(ids), k), -np.inf)

    def _merge(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        met = np.unique(q)
        q = np.concatenate([np.repeat(met, self.k), q])
        ids = np.concatenate([self.near[met].ravel(), ids])
        scores = np.concatenate([self.scores[met].ravel(), scores])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        # a pair that is met again counts once; the places without a neighbour yet stay
        new = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1]) | (scores[1:] == -np.inf)]
        q, ids, scores = q[new], ids[new], scores[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = rank < self.k
        self.near[q[best], rank[best]], self.scores[q[best], rank[best]] = ids[best], scores[best]

    def _rerank(self, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        for start in range(0, len(q), PAIRS):
            a, b = q[start : start + PAIRS], rows[start : start + PAIRS]
            self._merge(a, ids[b], ordered_dot(vectors[b], self.queries[a]) / (norms[b] * self.norms[a]))

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, correction: np.ndarray, error: np.ndarray) -> None:
        """Look through a block of vectors and their codes."""
        # of equal vectors only the k + 1 smallest ids can be among the best of a query: one may be its own
        _, group = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)
        order = np.lexsort((ids, group))
        first = order[np.r_[True, (group[order][1:] != group[order][:-1]) | (ids[order][1:] != ids[order][:-1])]]
        g = group[first]
        kept = first[np.arange(len(g)) - np.searchsorted(g, g) <= self.k]
        ids, vectors, codes, correction, error = ids[kept], vectors[kept], codes[kept], correction[kept], error[kept]
        norms = np.sqrt(ordered_dot(vectors, vectors))
        signs = (np.unpackbits(codes, axis=1, count=self.dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(self.dim))
        for start in range(0, len(self.ids), QUERY_ROWS):
            mine = slice(start, start + QUERY_ROWS)
            upper = (self.turned[mine] @ signs.T) / correction[None, :] + error[None, :]
            upper[self.ids[mine, None] == ids[None, :]] = -np.inf
            open_ = np.flatnonzero(self.scores[mine, -1] == -np.inf)
            if len(open_):  # no floor yet: the likeliest give one
                top = np.argpartition(-upper[open_], min(4 * self.k, len(ids)) - 1, axis=1)[:, : 4 * self.k]
                q, rows = np.repeat(open_, top.shape[1]), top.ravel()
                there = upper[q, rows] > -np.inf
                self._rerank(q[there] + start, rows[there], ids, vectors, norms)
            q, rows = np.nonzero((upper >= self.scores[mine, -1][:, None]) & (upper > -np.inf))
            self._rerank(q + start, rows, ids, vectors, norms)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id, score of all that is found."""
        q, place = np.nonzero(self.scores > -np.inf)
        return self.ids[q], self.near[q, place], self.scores[q, place]


def usable(vector: str | Column) -> Column:
    """Vectors that take part: not null, not empty, all components finite, not zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def build_index(vectors: DataFrame, id: str, vector: str, seed: int = 7) -> DataFrame:
    """id, v, dim, code, correction, error of every usable vector."""
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.filter(usable(vector)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.size(vector).alias("dim"))

    def code(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                bits, correction, error = encode(_matrix(part.column("v"), int(dim)), seed)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(correction), pa.array(error)],
                    names=["id", "v", "dim", "code", "correction", "error"],
                )

    return rows.mapInArrow(code, f"id long, v {kind}, dim int, code binary, correction double, error double")


def search_index(index: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, seed: int = 7) -> DataFrame:
    """query_id, vec_id, score: the best k of each query in each task.  ``queries`` has (ids, matrix) by the vectors' length."""
    sent = index.sparkSession.sparkContext.broadcast(queries)  # QUERY_BYTES

    def run(batches):
        searches = {dim: Search(ids, matrix, k, seed) for dim, (ids, matrix) in sent.value.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in searches:
                    continue
                part = batch.filter(pa.array(dims == dim))
                for start in range(0, len(part), BLOCK_ROWS):
                    block = part.slice(start, BLOCK_ROWS)
                    codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(block), -1)
                    searches[dim].add(block.column("id").to_numpy(), _matrix(block.column("v"), dim), codes, block.column("correction").to_numpy(), block.column("error").to_numpy())
        for search in searches.values():
            columns = search.found()
            for start in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + (1 << 16)]) for c in columns], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` nearest others of every query row, by cosine.

    Null, empty, zero and non-finite vectors take no part; vectors meet only vectors of their own length.  Equal
    scores rank by the smaller id.  Rows that repeat an id are separate candidates, but never of their own id's
    query; a repeated query id is searched once for each of its vectors and ranked together without repeats.  An empty
    table gives an empty result; other columns are ignored.
    """
    index = materialize(build_index(vectors, id, vector, seed), "ann-index")
    queries = vectors.filter(is_query & usable(vector)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim")).distinct()
    queries = materialize(queries, "ann-queries")
    size = queries.agg(F.sum(F.col("dim") * 8 + 8)).first()[0] or 0
    # passes are dealt by hash over distinct rows, so none is much larger than the others
    passes = -(-size // QUERY_BYTES) or 1
    found = None
    for i in range(passes):
        part = queries.filter(F.pmod(F.xxhash64("id", "v"), F.lit(passes)) == i).toArrow()  # about QUERY_BYTES
        dims = part.column("dim").to_numpy()
        sent = {int(d): ((mine := part.filter(pa.array(dims == d))).column("id").to_numpy(), _matrix(mine.column("v"), int(d))) for d in np.unique(dims)}
        got = search_index(index, sent, k, seed)
        got = materialize(got, "ann-found") if passes > 1 else got
        found = got if found is None else found.unionByName(got)
    discard(queries)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: Brute force in double precision, summed from left to right as the operator does.
SQL = """
WITH ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda x, y: x + y)) AS len_v FROM ok),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_reduce(list_transform(list_zip(c.v, q.v), lambda z: z[1] * z[2]), lambda x, y: x + y) / (c.len_v * q.len_v) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
