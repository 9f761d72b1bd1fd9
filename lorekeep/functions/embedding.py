"""Embeddings as a pluggable function: off unless a caller brings one; no call leaves the cluster by itself."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import col

MAX_CHARS = 8_000
#: Providers in order of preference, the variable that holds a key, and the length of their vectors.
PROVIDERS = (("openai", "OPENAI_API_KEY", 512), ("voyage", "VOYAGE_API_KEY", 1024), ("gemini", "GEMINI_API_KEY", 768))


def provider(environment: Mapping[str, str], opted_in: bool = False) -> tuple[str, int] | None:
    """(name, dimension) of the first provider with a key; none without consent."""
    return next(((name, dim) for name, key, dim in PROVIDERS if opted_in and environment.get(key)), None)


def clipped(text: str | Column) -> Column:
    """What is embedded of a text."""
    return F.substring(col(text), 1, MAX_CHARS)


def embedder(embed: Callable[[list[str]], list[list[float] | None]]):
    """A vectorised function from texts to ``array<float>``; a batch that fails gives nulls."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        clipped_ = [t[:MAX_CHARS] if t else "" for t in texts]
        try:
            return pd.Series(embed(clipped_), index=texts.index, dtype=object)
        except Exception:
            return pd.Series([None] * len(texts), index=texts.index, dtype=object)

    return run


def cosine(a: str | Column, b: str | Column) -> Column:
    """Of two arrays of one length; null for a zero vector."""
    fold = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = col(a), col(b)
    return fold(a, b) / F.nullif(F.sqrt(fold(a, a)) * F.sqrt(fold(b, b)), F.lit(0.0))


def register(spark: SparkSession, embed: Callable[[list[str]], list[list[float] | None]] | None = None) -> None:
    """SQL functions of the pieces that are procedural: extract_tags, and embed if one is given."""
    from ..operators import tags

    stop = tags.stopwords()

    @F.pandas_udf("array<string>")
    def extract_tags(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tags.extract(t or "", tags.MAX_TAGS, stop))

    spark.udf.register("extract_tags", extract_tags)
    if embed is not None:
        spark.udf.register("embed", embedder(embed))
