"""Session construction for local runs and tests; on a cluster the caller's session is used as is."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of a session, unless their path has it anyway."""
    sc = spark.sparkContext
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.applicationId in _shipped or any(p and Path(p).resolve() == ROOT for p in places):
        return
    archive = Path(tempfile.mkdtemp()) / "lorekeep.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((ROOT / "lorekeep").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    return (given or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


_leaving: set[str] = set()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    if path in _leaving:
        return
    _leaving.add(path)

    @atexit.register
    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and survives the loss of executors.  It goes when the application ends, or by ``forget``."""
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    delete_at_exit(spark, home)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.written_at)


def release(spark: SparkSession) -> None:
    """Shuffle files are removed when the driver's garbage is collected; this asks for it after large jobs."""
    spark._jvm.System.gc()


def local_session(cpus: int | str = "*", app: str = "lorekeep", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
