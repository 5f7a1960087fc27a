"""Candle tables: create, append, upsert, compact, mark.

Formats with row-level operations (``ROW_LEVEL``) are changed with ``MERGE INTO``; of these Iceberg
partitions by a hidden transform of the timestamp. Tables of plain files have a stored partition column named
after their grain (``year``, ``month`` or ``day``), and are changed by replacing the partitions
concerned; they take one writer at a time, and a reader may see the change of several partitions
half done. A year is the usual grain. Choose a finer one where a year of data is too much to
rewrite for a correction.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickwork.functions.frequency import to_micros
from wickwork.operators.candles import latest_timestamp
from wickwork.plans.joins import null_safe_join
from wickwork.schema import CANDLE_SCHEMA, DEFAULT_MARK, TIMESTAMP_FORMAT

ROW_LEVEL = ("iceberg", "delta", "hudi")
HIDDEN = ("iceberg",)
#: The settings of a session are shared by its threads; one write of a session at a time may depend on
#: them. Every stream writes in a session of its own, so streams do not wait for each other.
_LOCKS: dict[str, threading.RLock] = {}
_NEW_LOCK = threading.Lock()
#: Size of a compacted file, unless a number of files is given.
TARGET_BYTES = 128 << 20
GRAINS = {
    "year": lambda ts: F.year(ts),
    "month": lambda ts: F.date_format(ts, "yyyy-MM"),
    "day": lambda ts: F.to_date(ts),
}
GRAIN_TYPES = {"year": "int", "month": "string", "day": "date"}


def use_namespace(spark: SparkSession, namespace: str, catalog: str | None = None) -> None:
    """Select the catalog, and create the namespace if it is not there."""
    if catalog:
        spark.catalog.setCurrentCatalog(catalog)
        namespace = f"{catalog}.{namespace}"
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")


def create_table(
    spark: SparkSession,
    table: str,
    fmt: str = "parquet",
    schema: T.StructType = CANDLE_SCHEMA,
    ts: str = "Timestamp",
    grain: str = "year",
    location: str | None = None,
    use_sql: bool = True,
) -> bool:
    """Create the table partitioned by ``grain``, unless it exists. True if it was created."""
    if spark.catalog.tableExists(table):
        return False
    hidden = fmt in HIDDEN
    if use_sql:
        spark.sql(create_statement(table, fmt, schema, ts, grain, location))
        return True
    empty = spark.createDataFrame([], schema)
    if hidden:
        part = getattr(F.partitioning, f"{grain}s")(F.col(ts))
    else:
        empty, part = with_partition(empty, ts, grain), F.col(grain)
    writer = empty.writeTo(table).using(fmt).partitionedBy(part)
    if location:
        writer = writer.option("path", location)
    writer.create()
    return True


def create_statement(
    table: str, fmt: str, schema: T.StructType, ts: str = "Timestamp", grain: str = "year", location: str | None = None
) -> str:
    columns = [f"`{field.name}` {field.dataType.simpleString()}" for field in schema]
    if fmt in HIDDEN:
        part = f"{grain}s(`{ts}`)"
    else:
        columns.append(f"`{grain}` {GRAIN_TYPES[grain]}")
        part = f"`{grain}`"
    place = f" LOCATION '{location}'" if location else ""
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(columns)}) USING {fmt} PARTITIONED BY ({part}){place}"


def merge_statement(table: str, keys: Sequence[str], update: bool = True) -> str:
    """``{source}`` stands for the rows to merge."""
    match = " AND ".join(f"t.`{key}` = s.`{key}`" for key in keys)
    changed = "WHEN MATCHED THEN UPDATE SET * " if update else ""
    return f"MERGE INTO {table} t USING {{source}} s ON {match} {changed}WHEN NOT MATCHED THEN INSERT *"


def with_partition(df: DataFrame, ts: str = "Timestamp", grain: str = "year") -> DataFrame:
    """Add the stored partition column."""
    return df.withColumn(grain, GRAINS[grain](F.col(ts)).cast(GRAIN_TYPES[grain]))


def partition_column(spark: SparkSession, table: str) -> str | None:
    """The stored partition column made from the timestamp, if the table has one."""
    names = [column.name for column in spark.catalog.listColumns(table) if column.isPartition]
    return next((name for name in names if name in GRAINS), None)


def supports_merge(spark: SparkSession, table: str) -> bool:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Provider'").first()
    return bool(described) and described["data_type"].lower() in ROW_LEVEL


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The table as it is now. Streams write in sessions of their own, whose changes this session's
    cached list of files does not show."""
    spark.catalog.refreshTable(table)
    return spark.table(table)


def read_range(spark: SparkSession, table: str, start: str, end: str, ts: str = "Timestamp") -> DataFrame:
    """Rows of ``[start, end)``. The range is also put as one of the stored partition column, as
    Spark cannot prune that by a condition on the timestamp alone."""
    low, high = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    df = read_table(spark, table).where((F.col(ts) >= low) & (F.col(ts) < high))
    grain = partition_column(spark, table)
    if grain:
        part = GRAINS[grain]
        df = df.where(F.col(grain).between(part(low), part(high)))
    return df


def _laid_out(df: DataFrame, ts: str, table: str, grain: str | None, clustered: bool) -> DataFrame:
    """Columns in the table's order, few files per partition, each sorted by time.

    The rebalance hint lets AQE cut a hot partition into many tasks and join small ones, and reads
    the source once. ``clustered`` cuts by ranges of time instead, so that readers can skip files
    by time; to find the ranges Spark goes over the source twice.
    """
    if grain and grain not in df.columns:
        df = with_partition(df, ts, grain)
    df = df.select(*df.sparkSession.table(table).columns)
    order = [name for name in (grain, ts) if name]
    df = df.repartitionByRange(*order) if clustered else df.hint("rebalance", *order[:-1])
    return df.sortWithinPartitions(*order)


def append(
    df: DataFrame,
    table: str,
    ts: str = "Timestamp",
    max_rows_per_file: int | None = None,
    observe_as: Observation | None = None,
    clustered: bool = False,
) -> None:
    """Append the rows, each file in time order. ``observe_as`` gets the number of rows written as
    ``rows``, counted while they pass, so that the source is not read again for it."""
    spark = df.sparkSession
    rows = _laid_out(df, ts, table, partition_column(spark, table), clustered)
    if observe_as is not None:
        rows = rows.observe(observe_as, F.count(F.lit(1)).alias("rows"))
    if supports_merge(spark, table):
        rows.writeTo(table).append()
        return
    with _settings(spark, **{"spark.sql.files.maxRecordsPerFile": str(max_rows_per_file or 0)}):
        rows.write.mode("append").insertInto(table)


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """Session settings for one write; ``insertInto`` takes no options of its own."""
    with _NEW_LOCK:
        lock = _LOCKS.setdefault(spark._jsparkSession.sessionUUID(), threading.RLock())
    with lock:
        before = {key: spark.conf.get(key) for key in values}
        try:
            for key, value in values.items():
                spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)


def _replace_partitions(rows: DataFrame, table: str) -> None:
    """Write rows in place of the partitions they fall into; others stay as they are.

    The new files are staged and moved in when all of them are written, hence the rows may come
    from the same partitions.
    """
    with _settings(rows.sparkSession, **{"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        rows.write.mode("overwrite").insertInto(table)


def upsert(
    source: DataFrame,
    table: str,
    keys: Sequence[str] = ("Timestamp",),
    ts: str = "Timestamp",
    update: bool = True,
) -> None:
    """Update the rows whose key is there, insert the others. Rows with a null key are left out.

    Of copies of a key in the source the largest row counts. With ``update=False`` rows that are
    there stay as they are.

    Row-level formats do this with ``MERGE INTO``. For plain files, the keys already there are
    looked up first, in the touched partitions and within the source's range of times, reading the
    key columns only. Partitions with none of them just get rows appended, which is all that
    happens for new candles; the others are rewritten from what is kept and the source. Running it
    again with the same source changes nothing.
    """
    spark, keys = source.sparkSession, list(keys)
    others = [name for name in source.columns if name not in keys]
    source = source.dropna(how="any", subset=keys)
    if others:
        largest = F.max(F.struct(*others)).alias("_row")
        source = source.groupBy(*keys).agg(largest).select(*[name if name in keys else F.col("_row")[name].alias(name) for name in source.columns])
    else:
        source = source.distinct()
    if supports_merge(spark, table):
        grain = partition_column(spark, table)
        if grain and grain not in source.columns:
            source = with_partition(source, ts, grain)
        spark.sql(merge_statement(table, keys, update), source=source)
        return
    if ts not in keys:
        raise ValueError(f"the keys of a table of plain files must hold {ts}, by which rows are found")
    grain = partition_column(spark, table)
    if grain is None:
        raise ValueError(f"{table} has no stored partition column to replace rows by")
    source = with_partition(source, ts, grain).persist()
    try:
        # One row per touched partition: as many as there are years, months or days at most.
        ranges = source.groupBy(grain).agg(F.min(ts).alias("low"), F.max(ts).alias("high")).collect()
        if not ranges:
            return
        target = read_table(spark, table).where(F.col(grain).isin([row[grain] for row in ranges]))
        low, high = min(row["low"] for row in ranges), max(row["high"] for row in ranges)
        present = target.where(F.col(ts).between(F.lit(low), F.lit(high))).join(source, keys, "left_semi")
        changed = [row[0] for row in present.select(grain).distinct().collect()]

        if changed and not update:
            fresh = source.join(target, keys, "left_anti").select(*source.columns).persist()
            try:
                append(fresh, table, ts)
            finally:
                fresh.unpersist()
            return
        in_changed = F.col(grain).isin(changed)
        if changed:
            kept = target.where(in_changed).join(source.where(in_changed), keys, "left_anti")
            rewritten = kept.unionByName(source.where(in_changed).select(*kept.columns))
            _replace_partitions(_laid_out(rewritten, ts, table, grain, clustered=False), table)
        if len(changed) < len(ranges):
            append(source.where(~in_changed), table, ts)
    finally:
        source.unpersist()


def file_sizes(rows: DataFrame, partition: str) -> DataFrame:
    """``partition``, ``file``, ``bytes`` and ``rows`` of the files that plain-file rows come from.

    The scan reads no column but those of the file itself."""
    meta = rows.select(partition, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return meta.groupBy(partition, "file").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _files_of(rows: DataFrame, partition: str, target_bytes: int) -> dict:
    """How many files each partition is to have. One row per partition comes to the driver."""
    sizes = file_sizes(rows, partition).groupBy(partition).agg(F.sum("bytes").alias("bytes")).collect()
    return {row[0]: max(1, round(row["bytes"] / target_bytes)) for row in sizes}


def _bin(key: Column, cuts: Column, most: int) -> Column:
    """How many of the ascending ``cuts`` (``most`` at most) are below ``key``, by halving."""
    steps = [1 << i for i in reversed(range(most.bit_length()))]

    def step(at: Column, by: Column) -> Column:
        return F.when(F.get(cuts, at + by - 1) < key, at + by).otherwise(at)

    return F.aggregate(F.array(*[F.lit(by) for by in steps]), F.lit(0), step)


def compact(
    spark: SparkSession,
    table: str,
    values: Sequence,
    files: int | None = None,
    partition: str = "year",
    ts: str = "Timestamp",
    target_bytes: int = TARGET_BYTES,
) -> None:
    """Rewrite each of the partitions into files of about the same size, in one job.

    ``files`` per partition, or as many as the partition's bytes need for files of ``target_bytes``.
    Files hold consecutive stretches of time. They are cut at quantiles of (time, hash of the row), so
    the rows of one time, however many, are shared out as well, and a task has one file's rows.
    Identical rows stay together. Other partitions are not touched.
    """
    values = list(dict.fromkeys(values))
    if not values:
        return
    rows = read_table(spark, table)
    columns = rows.columns
    if partition not in columns:  # hidden
        rows = with_partition(rows, ts, partition)
    # Values may come as text, as from a command line.
    kind = rows.schema[partition].dataType
    rows = rows.where(F.col(partition).isin(*[F.lit(value).cast(kind) for value in values]))
    merges = supports_merge(spark, table)
    if files is not None:
        counts = {row[0]: files for row in rows.select(partition).distinct().collect()}
    elif merges:
        raise ValueError("the files of such a table are its own; say how many there are to be")
    else:
        counts = _files_of(rows, partition, target_bytes)
    if not counts:
        return

    # One whole number per row: its time within the partition, and below that a part of its hash.
    time = to_micros(F.col(ts))
    bounds = rows.groupBy(partition).agg(F.min(time).alias("_low"), F.max(time).alias("_high"))
    rows = null_safe_join(rows, bounds, [partition])
    share = F.call_function("div", F.lit(1 << 62), F.col("_high") - F.col("_low") + 1)
    key = (time - F.col("_low")) * share + F.pmod(F.xxhash64(*columns), share)
    rows = rows.withColumn("_key", F.coalesce(key, F.lit(0))).drop("_low", "_high")

    first, cut_at = {}, []
    for number in sorted(set(counts.values())):
        if number > 1:
            mine = F.when(F.col(partition).isin([value for value, n in counts.items() if n == number]), F.col("_key"))
            fractions = [i / number for i in range(1, number)]
            cut_at.append(F.percentile_approx(mine, fractions, F.lit(max(10_000, 50 * number))))
    total = 0
    for value, number in counts.items():
        first[value] = total
        total += number
    if cut_at:
        # One row per partition. AQE broadcasts it where it is small, and splits hot partitions if not.
        cuts = rows.groupBy(partition).agg(F.coalesce(*cut_at, F.array().cast("array<bigint>")).alias("_cuts"))
        rows = null_safe_join(rows, cuts, [partition])
        target = _bin(F.col("_key"), F.col("_cuts"), max(counts.values()) - 1)
    else:
        target = F.lit(0)
    place = F.lit(None).cast("int")
    for value, start in first.items():
        place = F.when(F.col(partition).eqNullSafe(F.lit(value)), F.lit(start)).otherwise(place)
    rows = rows.repartitionById(total, (place + target).cast("int")).sortWithinPartitions(partition, ts).select(*columns)
    if merges:
        rows.writeTo(table).overwritePartitions()
    else:
        _replace_partitions(rows, table)


def partition_values(spark: SparkSession, table: str, grain: str) -> list[str]:
    """The values of the stored partition column as text, ascending, as the catalog lists them."""
    listed = [row[0].split("/") for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    found = (part.partition("=")[2] for parts in listed for part in parts if part.startswith(f"{grain}="))
    return sorted({value for value in found if value != "__HIVE_DEFAULT_PARTITION__"})


def table_bounds(spark: SparkSession, table: str, ts: str = "Timestamp") -> DataFrame:
    """First and last time of a table (``min_ts``, ``max_ts``, one row, null if it is empty).

    Stored partitions follow the time, so only the first and the last of them that hold a time are read.
    """
    grain, rows = partition_column(spark, table), read_table(spark, table)
    if supports_merge(spark, table) or not grain:
        return rows.agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))
    values = partition_values(spark, table, grain)

    def edge(names: list[str]) -> DataFrame | None:
        for value in names:
            part = rows.where(F.col(grain) == F.lit(value).cast(GRAIN_TYPES[grain])).select(ts)
            if not part.where(F.col(ts).isNotNull()).isEmpty():
                return part
        return None

    first, last = edge(values), edge(values[::-1])
    if first is None or last is None:
        first = last = rows.where(F.lit(False)).select(ts)
    kind = rows.schema[ts].dataType
    ends = first.select(F.col(ts).alias("min_ts"), F.lit(None).cast(kind).alias("max_ts")).unionByName(
        last.select(F.lit(None).cast(kind).alias("min_ts"), F.col(ts).alias("max_ts"))
    )
    return ends.agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


def latest_mark(spark: SparkSession, table: str, ts: str = "Timestamp", default: str = DEFAULT_MARK) -> str:
    """The latest time in a table as text; the default if it is empty or not there."""
    if not spark.catalog.tableExists(table):
        return default
    found = table_bounds(spark, table, ts).select(F.col("max_ts").alias(ts))
    return latest_timestamp(found, ts, default).first()["latest"]


def entity_defaults(spark: SparkSession, marks: dict[str, str], symbol: str = "symbol") -> DataFrame:
    """The first timestamp of each entity as a small table, for :func:`latest_per_symbol`."""
    rows = [
        F.struct(F.lit(entity).alias(symbol), F.to_timestamp(F.lit(text), TIMESTAMP_FORMAT).alias("default_ts"))
        for entity, text in marks.items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
