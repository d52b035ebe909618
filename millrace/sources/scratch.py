"""Tables that are written once to the folder that the driver and all executors share, and read again: a lost executor costs no more than a new read."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir. Where it is unset, a local one, but only if all of Spark runs on this machine."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


#: Paths of stored tables that are still there; the rest goes when the driver's Python ends.
_HELD: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's Python ends, or before by remove_stored()."""
    path = f"{scratch_dir(spark)}/millrace-{name}-{uuid.uuid4().hex[:12]}"
    _HELD.add(path)
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if path not in _HELD or jvm is None or spark.sparkContext._jsc is None:
        return
    _HELD.discard(path)
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM has ended before; nothing is left to tidy from here
        return


def is_whole(spark: SparkSession, path: str) -> bool:
    """Whether a table lies there that was written to its end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def listed(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder: another value tells that its tables were written anew."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found))


#: Spark's setting that lets shuffle files go when a query ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def reachable(spark: SparkSession) -> SparkSession:
    """The session, with this package's folder on the path of Python workers on machines that have it; elsewhere, submit with --py-files."""
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [root, held]))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again. The shuffles of the write go with its end, as only the written table is read later."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove_stored(*tables: DataFrame) -> None:
    """Deletes tables that stored() made and that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._stored_at)
