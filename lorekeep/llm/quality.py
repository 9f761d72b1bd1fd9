"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts in Arrow functions.  Trees are grown on binned statistics of a bounded sample
of the labelled rows, then flattened into arrays (feature, threshold, left child, value) that numpy walks for all
rows of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, free_name, table, text_or_empty

#: Labelled rows that a model is fitted on at most, chosen by the hash of their id.
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "chars_a_word", "word_variety", "top_word", "adjacent_repeats", "log_longest_word", "upper", "digit", "symbol", "pipe", "exclamation",
    "hash_star", "punctuation", "blank", "line_feed", "other_bytes", "symbol_words", "upper_words", "number_words", "line_variety", "words_a_line", "short_words", "first_half_variety",
)
_CLASS = np.zeros(256, np.uint8)
for _chars, _class in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"|", 3), (b"!", 4), (b"#*$%&@^~=+_<>{}[]\\/", 5), (b".,;:?'\"()-", 6), (b" \t", 7), (b"\n\r", 8), (b"abcdefghijklmnopqrstuvwxyz", 9)):
    _CLASS[list(_chars)] = _class
_CLASS[128:] = 10


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole text, finite for any text, the empty one included."""
    size = len(text) or 1
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=bytes_, minlength=11) / size
    words = text.split()
    n = len(words) or 1
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    half = words[: (len(words) + 1) // 2]
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / n, len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, np.log1p(max(map(len, counts), default=0)),
        kinds[1], kinds[2], kinds[5], kinds[3], kinds[4], (bytes_[35] + bytes_[42]) / size, kinds[6], kinds[7], kinds[8], kinds[10],
        sum(c for w, c in counts.items() if w[-1:] in b"#*$%&|!") / n, sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n, sum(c for w, c in counts.items() if w.isdigit()) / n,
        len(set(lines)) / (len(lines) or 1), n / (len(lines) or 1), sum(c for w, c in counts.items() if len(w) < 4) / n, len(set(half)) / (len(half) or 1),
    ]


class Trees:
    """Boosted trees for log-odds, as flat arrays: a leaf's children are itself."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, value: np.ndarray, roots: np.ndarray, depth: int):
        self.base, self.feature, self.threshold, self.left, self.value, self.roots, self.depth = base, feature, threshold, left, value, roots, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all trees step down together, level by level."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            left = self.left[node]
            step = left + (x[rows, self.feature[node]] > self.threshold[node])
            node = np.where(left >= 0, step, node)
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Trees:
    """Grow the trees on histograms of at most ``bins`` quantile bins a statistic; deterministic."""
    positive = float(y.sum()) + 0.5
    base = float(np.log(positive / (len(y) - y.sum() + 0.5)))
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    value: list[float] = []
    roots: list[int] = []
    flat = lambda: Trees(base, np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(value), np.array(roots, np.int32), depth)
    if len(np.unique(y)) < 2:
        return flat()
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1).astype(np.int64)  # bin b: edges[b-1] < x <= edges[b]
    n, m = codes.shape
    offset = np.arange(m) * bins
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(len(feature))
        level = [(len(feature), np.arange(n))]
        feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
        for d in range(depth + 1):
            below = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                best = None
                if d < depth and len(rows) >= 2 * least:
                    at = (codes[rows] + offset).ravel()
                    hist = [np.bincount(at, weights=np.repeat(w, m), minlength=m * bins).reshape(m, bins).cumsum(axis=1) for w in (g[rows], h[rows])]
                    cnt = np.bincount(at, minlength=m * bins).reshape(m, bins).cumsum(axis=1)
                    gain = hist[0] ** 2 / (hist[1] + ridge) + (gs - hist[0]) ** 2 / (hs - hist[1] + ridge) - gs**2 / (hs + ridge)
                    gain[(cnt < least) | (len(rows) - cnt < least)] = -1
                    f, b = divmod(int(gain.argmax()), bins)
                    if gain[f, b] > 1e-6 and b < len(edges[f]):
                        best = f, b
                if best is None:
                    value[node] = rate * gs / (hs + ridge)
                    margin[rows] += value[node]
                    continue
                f, b = best
                feature[node], threshold[node], left[node] = f, float(edges[f][b]), len(feature)
                low = codes[rows, f] <= b
                for part in (rows[low], rows[~low]):
                    below.append((len(feature), part))
                    feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
            level = below
    return flat()


def held_out(key: str) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _with_statistics(rows: DataFrame, body: str):
    schema = rows.drop(body).schema.add("x", T.ArrayType(T.DoubleType()))

    def run(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column(body).to_pylist()]
            keep = [i for i, c in enumerate(batch.schema.names) if c != body]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(x, pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Fit on at most ``sample`` labelled ids outside the held-out fold, chosen by the hash of their id.

    Of labels that repeat an id the least counts, of documents that do the first by the hash of the text, so that no
    more than ``sample`` rows of statistics reach the driver.  Null texts count as empty.  Without labels, or with one
    label only, the model gives all texts the same score.
    """
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.min(F.col(label).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k", "y").limit(sample)  # its size bound makes it fit to broadcast
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).cast("binary").alias("t")).join(F.broadcast(chosen), "k")
    rows = rows.groupBy("k").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m")).select("k", "y", F.col("m.t").alias("t"))
    got = _with_statistics(rows, "t").toArrow()
    x, y, k = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES)), got.column("y").to_numpy(), got.column("k").to_numpy()
    order = np.lexsort((*x.T, y, k))
    return fit(x[order], y[order].astype(float))


def classify(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with held_out, score (0 to 1) and predicted (1 if score >= 0.5).

    Null texts count as empty and are scored as such; null ids are not held out; repeated rows are scored each.
    Existing columns of the three names are replaced.
    """
    bound_batches(docs.sparkSession)
    kept = docs.drop("held_out", "score", "predicted")
    body = free_name(kept, "body")
    rows = kept.withColumn(body, text_or_empty(text).cast("binary")).drop(text)
    schema = rows.drop(body).schema.add("score", "double")

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(body).to_pylist()], float).reshape(-1, len(FEATURES))
            keep = [i for i, c in enumerate(batch.schema.names) if c != body]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(model.score(x))], names=schema.names)

    return rows.mapInArrow(run, schema).withColumns({"held_out": held_out(key), "predicted": (F.col("score") >= 0.5).cast("int")})


def keep_good(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``model`` does not reject (score >= 0.5), with their columns and whatever these are called.

    Null texts are scored as empty ones and stay null if kept; repeated rows share one fate; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    body, schema = free_name(docs, "body"), docs.schema

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(body).to_pylist()], float).reshape(-1, len(FEATURES))
            good = batch.filter(pa.array(model.score(x) >= 0.5))
            yield good.select([c for c in good.schema.names if c != body])

    return docs.withColumn(body, text_or_empty(text).cast("binary")).mapInArrow(run, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
