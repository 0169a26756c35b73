"""Lineage cuts in the shared folder that the cluster names.

``spark.checkpoint.dir`` is read from the session; only where it is unset (as
in local tests) a folder of our own is used.  A cut writes Parquet there and
reads it back, so a lost executor costs a re-read and never a recomputation of
a half-forgotten plan, and a later stage scans only the columns it needs.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
#: Where each table that ``cut`` returned lies.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's; one of our own only if driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        made = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, made, True)
        _LOCAL.append("file://" + made)
    return _LOCAL[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # this plan's shuffle files go as soon as the table is written
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` returned, once all that is made of them is written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(table))
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for an operator's real output."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def dealt_join(left: DataFrame, right: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has each key once and in ``n`` how many of ``left``'s ``total`` rows have it.

    Keys of more than 1/``share`` of all rows, at most ``share`` of them, are broadcast, so no task gets all rows of a common key.
    """
    common = right.where(F.col("n") * share > total)
    if common.isEmpty():
        return left.join(right, key)
    rare = left.join(F.broadcast(common.select(key)), key, "left_anti")
    return left.join(F.broadcast(common), key).unionByName(rare.join(right, key))


def numbered_copies(rows: DataFrame, many: str, number: str, keys: list[str], step: int = 1000) -> DataFrame:
    """``rows`` as often as column ``many`` says, numbered from 0; if that is more than ``step``, first one for every ``step`` copies, then these, so no task makes all."""
    chunks = rows.withColumn("_at", F.explode(F.expr(f"sequence(0L, ({many} - 1) div {step})")))
    if rows.where(F.col(many) > step).limit(1).count():
        chunks = chunks.repartition(*keys, "_at")
    return chunks.withColumn(number, F.explode(F.expr(f"sequence(_at * {step}, least({many}, (_at + 1) * {step}) - 1)"))).drop("_at", many)


def python_ready(spark: SparkSession, rows: int = 1024, size: int = 16 << 20) -> None:
    """Send this package's functions to Python workers by value, so that executors need no copy of it, and bound an Arrow batch: whole texts may be long, so its bytes are few."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    cloudpickle.register_pickle_by_value(sys.modules[__package__])


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, after which a Python worker, which waits for its next task, gives free memory back."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return own
