"""What the operators share: reading tables, written intermediate tables, spare column names."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wickwork.session import scratch_path, ship_package, use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends here, and a lost
    executor costs a read instead of the work so far."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that go to a Python worker at a time, unless the session says otherwise. Spark's own 64 MB are
#: a multiple of that once they are Python strings.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def with_python(spark: SparkSession) -> SparkSession:
    """Executors are about to run functions of this package."""
    ship_package(use_utc(spark))
    if spark.conf.get(_BATCH) == f"{64 << 20}b":
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    return spark


def release() -> None:
    """What this process has freed goes back to the system: Arrow's buffers, then those of the C library (numpy's)."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def releasing(function: Callable) -> Callable:
    """``function`` of a Python worker, with ``release`` after each batch.

    Workers outlive their tasks, and several wait in each executor. Left alone, their allocators
    keep the most that any task of any stage before has needed, though nothing uses it.
    """
    if inspect.isgeneratorfunction(function):

        @wraps(function)
        def run(batches):
            for out in function(batches):
                yield out
                del out
                release()
            release()

    else:

        @wraps(function)
        def run(*columns):
            try:
                return function(*columns)
            finally:
                release()

    return run


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened by underscores until no column of ``df`` has it (case aside)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def adding(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns renamed out of the way which the operator is about to add.

    A column of the same name, whatever its case, is kept as ``<name>_in`` (``_in_`` and so on).
    """
    for name in names:
        for column in df.columns:
            if column.lower() == name.lower():
                df = df.withColumnRenamed(column, free_name(df, f"{column}_in"))
    return df
