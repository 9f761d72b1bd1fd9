"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are the runs between it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
LONG_WORD = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local session has one of our own where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or f"{tempfile.gettempdir()}/checkpoints/lorekeep")
    return sc.getCheckpointDir()


def tables_dir(spark: SparkSession) -> str:
    """The folder of all intermediate tables of an application."""
    return f"{shared_dir(spark)}/lorekeep-{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables of the application.  Results that have not been read yet may read some of them."""
    _delete(spark, tables_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_dropped_at_exit: set[str] = set()


def _drop_at_exit(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _dropped_at_exit:
        return
    _dropped_at_exit.add(app)

    @atexit.register
    def drop() -> None:
        if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
            drop_tables(spark)


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage by writing a Parquet table to the shared folder; survives the loss of executors.

    What is not deleted by ``discard`` goes when the application ends.
    """
    path = f"{tables_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _drop_at_exit(df.sparkSession)
    df.write.parquet(path, compression=codec)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.materialized_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more, and let finished jobs' shuffle files go."""
    for df in tables:
        _delete(df.sparkSession, df.materialized_at)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Shuffle files are removed when the driver's garbage is collected; this asks for it after large jobs."""
    spark._jvm.System.gc()


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold so many rows at most: rows here are whole texts, far larger than those of other tables."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 25)):
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have yet (names clash without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(col: str | object = "text"):
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: A blank that may not be where a text is cut: what is before it is neither letter, digit nor a printable ASCII sign.
_UNSAFE_BLANK, _SAFE_BLANK = re.compile(r"(?<![\w!-~]) "), re.compile(r"(?<=[\w!-~]) ")


def chunks(text: str) -> list[str]:
    """``text`` cut at blanks, which are left out: " ".join gives the text back.

    Tokenizers of words do not reach over these blanks: no merge, normalization or special string does.  Blanks that
    follow another white space, a combining mark or the like do not cut.
    """
    return text.split(" ") if not _UNSAFE_BLANK.search(text, 1) else _SAFE_BLANK.split(text)


class WordCache(dict):
    """word -> value of ``make``; two generations bound the memory while frequent words stay.  Very long words are not kept."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) > LONG_WORD:
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns byte by byte (numbers have few of their high bytes), uint32 as differences, compressed."""
    planes = []
    for c in columns:
        if c.dtype == np.uint32:
            c = np.diff(c, prepend=np.uint32(0))
        planes.append(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    """The ``n`` values of each of the packed columns."""
    data = zstandard.ZstdDecompressor().decompress(data)
    out, start = [], 0
    for kind in map(np.dtype, kinds):
        plane = np.frombuffer(data, np.uint8, n * kind.itemsize, start).reshape(kind.itemsize, n)
        column = np.ascontiguousarray(plane.T).view(kind).reshape(n)
        out.append(np.cumsum(column, dtype=np.uint32) if kind == np.uint32 else column)
        start += n * kind.itemsize
    return out
