"""Where intermediate tables live, and how long plans are cut.

Iterative operators (connected components, pointer jumping) and operators that
read one intermediate several times write it as a Parquet table in the shared
folder the cluster names in ``spark.checkpoint.dir``.  A written table survives
the loss of executors, and its size is known to AQE when it is read back.
"""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import partial
from pathlib import Path
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that are worth a task of their own when every row is passed many times.
ROWS_A_TASK = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, else the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    folder = _scratch.get() or f"{shared_dir(spark)}/dataquarry"
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


_scratch: ContextVar[str] = ContextVar("scratch", default="")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared storage."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside go when it ends; what shall last must have been written elsewhere by then.

    It covers this thread and those of ``concurrently``.
    """
    folder = new_path(spark, "scratch")
    outer = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(outer)
        remove(spark, folder)


# Spark keeps the shuffle files of a query until its driver collects garbage, unless this is set.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tidying: list[str | None] = []
_tidy_lock = threading.Lock()


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files when they end; the last of several threads restores the setting."""
    with _tidy_lock:
        _tidying.append(_tidying[0] if _tidying else spark.conf.get(_TIDY, None))
        spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        with _tidy_lock:
            before = _tidying.pop()
            if not _tidying:
                spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` and return the table read back; its shuffle files go when it is written."""
    with _tidy(df.sparkSession):
        df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    return write_table(df, new_path(df.sparkSession, name))


def distil(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``build`` returns, written; the intermediates of its making are removed."""
    path = new_path(spark, name)
    with scratch(spark):
        return write_table(build(), path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialise`` returned, once nothing reads it any more."""
    files = table.inputFiles()
    if files:
        remove(table.sparkSession, unquote(files[0]).rsplit("/", 1)[0])


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input that arrives in fewer partitions than there are cores.

    For CPU-bound work on small files of one row group; a large table already has
    more partitions than cores and passes unchanged.  Call it on a scan: asking a
    plan with shuffles for its partitions would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if few else df


def balance(rows: DataFrame, name: str) -> DataFrame:
    """Rows over all cores, in even parts, for work that is dear per row or passes over them many times.

    A part counts by its rows: a file of one row group is cut into several parts of which one holds all
    rows.  Fewer than ``ROWS_A_TASK`` rows stay as they are.
    """
    sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]
    n = sum(sizes)
    wanted = min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS_A_TASK))
    return rows if wanted * max(sizes, default=0) <= 1.5 * n else materialise(rows.repartition(wanted), name)


_shipped: set[str] = set()


def ship(spark: SparkSession, *folders: str | Path) -> None:
    """Make this package (and further ones) importable in the Python workers, once per application."""
    packages = [Path(__file__).resolve().parent, *map(Path, folders)]
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="dataquarry-")) / "dataquarry_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for package in packages:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def concurrently(spark: SparkSession, fn: Callable, items: Iterable, threads: int = 4) -> list:
    """``[fn(i) for i in items]`` as concurrent Spark jobs.

    Every call gets its own copy of the job properties; threads must not share one.
    """
    calls = [inheritable_thread_target(spark)(partial(copy_context().run, fn, i)) for i in items]
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]
