"""Working folders, size checks and small DataFrame helpers."""
from __future__ import annotations

import ctypes
import functools
import pickle
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workdir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    here = spark.sparkContext.getCheckpointDir()
    if here is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        here = "file://" + tempfile.mkdtemp(prefix="lakeledger-")
        spark.sparkContext.setCheckpointDir(here)
    return here.rstrip("/")


#: the paths that each operator at work has written, innermost last
_WRITTEN: list[list[tuple[str, str]]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{workdir(spark)}/{name}-{uuid.uuid4().hex}"
    if _WRITTEN:
        _WRITTEN[-1].append((name, path))
    return path


def cleared(*keep: str):
    """For an operator whose first argument is a DataFrame: when it returns, the tables that it stored are removed,
    but for those whose name begins with one of ``keep``, which its result still reads."""
    def wrap(f):
        @functools.wraps(f)
        def run(df, *args, **options):
            _WRITTEN.append([])
            try:
                return f(df, *args, **options)
            finally:
                remove(df.sparkSession, [p for name, p in _WRITTEN.pop() if not name.startswith(keep or ("\0",))])
        return run
    return wrap


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python workers ``rows`` at a time where the session has Spark's default of 10,000, which an executor holds
    several times over for each task, outside its heap; another setting stays."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(rows))


def return_heap(spark: SparkSession) -> int:
    """The driver and every executor collect their garbage and return the heap that is free to the system, for the Python
    workers of what follows; the executors' tasks that did so, one for each core."""
    spark._jvm.System.gc()
    cores = spark.sparkContext.defaultParallelism
    return len(spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).collect())


#: for each stage at work, innermost last, when the heap is to be returned again
_DUE: list[float] = []


def heap_returned(stage):
    """For a stage, whose first argument is the session: the heap is returned before it and, for a tenth of its time at most,
    before tables that it stores; a JVM keeps what it has touched, so its peaks creep up from table to table."""
    @functools.wraps(stage)
    def run(spark, *args, **options):
        _DUE.append(0.0)
        try:
            return_heap_if_due(spark)
            return stage(spark, *args, **options)
        finally:
            _DUE.pop()
    return run


def return_heap_if_due(spark: SparkSession) -> None:
    began = time.monotonic()
    if _DUE and began >= _DUE[-1]:
        return_heap(spark)
        now = time.monotonic()
        _DUE[-1] = now + 9 * (now - began)


#: what is stored is read by this job alone, which asks for no mark of success: two files less for each table, and on a local
#: disk a JVM starts a process for each file that it creates, which shares its memory until it runs a program of its own
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    modest_batches(spark)
    return_heap_if_due(spark)
    path = new_path(spark, name)
    writer = df.write.options(**UNMARKED)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(batches, rows: int = 1000):
    """The batches in parts of at most ``rows`` rows, for work that makes Python objects of them."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def trimmed(run):
    """``run`` over a task's batches, after which the worker, which lives on for other tasks, returns its free memory."""
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass
    return whole


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only if ``df``'s counted rows fit in ``limit``; beyond it Spark's own join choice holds."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, total_bytes: int, each: int = 32 << 20) -> int:
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(total_bytes or 0) // each))


def with_columns_of(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the wanted columns, cast to the wanted types, so extra or clashing names never matter."""
    return df.select(*[F.col(f"`{k}`").cast(t).alias(k) for k, t in wanted.items()])


class Shared:
    """A broadcast object whose classes travel by value; ``value`` is loaded once a task."""

    def __init__(self, spark: SparkSession, thing):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
        self._value = None

    def __getstate__(self):
        return {"_sent": self._sent, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._sent.value)
        return self._value
