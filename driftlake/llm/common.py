"""Helpers that the operators share: shared storage, row keys, word patterns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression: \x20 and \x09-\x0D.
WS = "[ \\t\\n\\x0B\\f\\r]+"
#: The same characters, for trim and translate.
WS_CHARS = " \t\n\x0b\x0c\r"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named (tests, local use)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="driftlake-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/driftlake/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended before; its folder then stays
            return


#: Spark's setting by which the shuffle files of an execution go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Executions in this context leave no shuffle files: for writes whose plan is not run again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: it outlives lost executors.

    files: how many its rows are worth at most; partitions beyond that number are put together.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        (df if files is None else df.coalesce(max(1, files))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes a table that materialise() made and that no plan reads any more."""
    for f in df.inputFiles()[:1]:
        drop_path(df.sparkSession, f.rsplit("/", 1)[0])


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """The narrow table `df` marked for a broadcast if it has `rows` rows at most; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores put before those that columns in `taken` have already."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list:
    """Columns by their names, whatever these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def trimming(run):
    """`run` for mapInArrow, giving back at its end the memory that an idle Python worker would hold."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return trimmed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols):
    """64 bits of a row's content, the same in every attempt of a task."""
    return F.xxhash64(*cols)
