"""Candles from ticks, and the small operators on candle tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.frequency import SECOND, floor_div, to_micros
from wickwork.operators.frames import block_width, order_limits, order_value
from wickwork.plans.blocks import drop_edges, forward, with_edges
from wickwork.plans.joins import null_safe_join
from wickwork.schema import BUFFER_SECONDS, DEFAULT_MARK, GRANULARITY_SECONDS, TIMESTAMP_FORMAT


def ohlcv_candles(
    ticks: DataFrame,
    value: str = "value",
    ts: str = "ts",
    keys: Sequence[str] = ("symbol",),
    granularity: int = GRANULARITY_SECONDS,
    volume: Column | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Low, high, open, close and volume (default: number of ticks) per series and time slot.

    Ticks of one time are taken in the order of ``order`` (say, a trade number), and then of their
    value, so that open and close are the same on every run.

    Every aggregate combines on the map side, so a hot symbol or a hot minute costs one row per
    task in the shuffle.
    """
    kind = ticks.schema[ts].dataType
    step = granularity * SECOND
    slot = F.timestamp_micros(floor_div(to_micros(F.col(ts)), step) * step).cast(kind)
    volume = F.count(F.lit(1)).cast("double") if volume is None else volume
    return ticks.groupBy(*keys, slot.alias("_slot")).agg(
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.min_by(value, F.struct(ts, *order, value)).alias("open"),
        F.max_by(value, F.struct(ts, *order, value)).alias("close"),
        volume.alias("volume"),
    ).withColumnRenamed("_slot", ts)


def latest_timestamp(df: DataFrame, ts: str = "ts", default: str = DEFAULT_MARK) -> DataFrame:
    """The latest time of a table as text in one row, or the default for an empty table."""
    return df.agg(F.coalesce(F.date_format(F.max(ts), TIMESTAMP_FORMAT), F.lit(default)).alias("latest"))


def latest_per_symbol(df: DataFrame, defaults: DataFrame, ts: str = "ts", symbol: str = "symbol") -> DataFrame:
    """The latest time of each symbol named in ``defaults`` (symbol, default_ts), or its default."""
    marks = df.groupBy(symbol).agg(F.max(ts).alias("_mark"))
    return defaults.join(marks, symbol, "left").select(
        symbol, F.date_format(F.coalesce("_mark", "default_ts"), TIMESTAMP_FORMAT).alias("latest")
    )


def freshness(
    df: DataFrame,
    now: Column,
    ts: str = "ts",
    keys: Sequence[str] = ("symbol",),
    buffer: int = BUFFER_SECONDS,
) -> DataFrame:
    """Seconds since the latest row of each series, and whether that is less than ``buffer``."""
    marks = df.groupBy(*keys).agg(F.max(ts).alias("latest"))
    lag = (to_micros(now) - to_micros(F.col("latest"))) / F.lit(float(SECOND))
    return marks.withColumn("lag_seconds", lag).withColumn("fresh", F.col("lag_seconds") < buffer)


def incremental_filter(
    df: DataFrame,
    marks: DataFrame | Column,
    ts: str = "ts",
    keys: Sequence[str] = ("symbol",),
    mark: str = "mark",
    with_first: bool = False,
) -> DataFrame:
    """Rows newer than the last load: than one mark, or than the mark of their series.

    A series without a mark passes whole, as does everything if the one mark is null. With
    ``with_first`` the earliest rows of each series pass as well, newer or not. The marks carry no
    broadcast hint: AQE broadcasts them if they turn out small, and splits a hot series if not.
    """
    columns, keys = df.columns, list(keys)
    if isinstance(marks, Column):
        marked = df.withColumn("_mark", marks)
    else:
        marked = null_safe_join(df, marks.select(*keys, F.col(mark).alias("_mark")), keys, "left")
    newer = F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))
    if with_first:
        first = df.groupBy(*keys).agg(F.min(ts).alias("_first"))
        marked = null_safe_join(marked, first, keys) if keys else marked.withColumn("_first", first.scalar())
        newer = newer | (F.col(ts) == F.col("_first"))
    return marked.where(newer).select(*columns)


def monotonic_filter(
    df: DataFrame,
    ts: str = "ts",
    arrival: str = "arrival",
    keys: Sequence[str] = ("symbol",),
    mark: Column | None = None,
    block: str | int | None = None,
    first_pass: bool = False,
) -> DataFrame:
    """Rows whose time exceeds that of every row which arrived before them.

    The largest time kept so far equals the largest time so far, so a running maximum decides; it
    runs block by block of ``arrival`` (unique within a series), each with the maximum of the
    blocks before it. With a ``mark`` from an earlier pass rows must exceed that as well; with
    ``first_pass`` rows without a mark all pass, as nothing was there to compare them to.
    """
    keys, columns = list(keys), df.columns
    if first_pass:
        if mark is None:
            return df
        marked = df.withColumn("_marked", mark)
        free = marked.where(F.col("_marked").isNull()).select(*columns)
        return free.unionByName(monotonic_filter(marked.where(F.col("_marked").isNotNull()).select(*columns), ts, arrival, keys, mark, block))
    if mark is not None:
        df = df.where(mark.isNull() | (F.col(ts) > mark))
    rows = df.withColumn("_order", order_value(df, arrival)).where(F.col("_order").isNotNull())
    edged = with_edges(rows, keys, "_order", block_width(df, arrival, block), maxima=[ts], limits=order_limits(df, arrival))
    earlier = forward(keys, "_order").rowsBetween(Window.unboundedPreceding, -1)
    kept = drop_edges(edged.withColumn("_max", F.max(ts).over(earlier)))
    return kept.where(F.col("_max").isNull() | (F.col(ts) > F.col("_max"))).select(*columns)


def dedup(
    df: DataFrame,
    keys: Sequence[str] = ("symbol", "ts"),
    arrival: str | None = None,
    keep: str = "first",
) -> DataFrame:
    """One row per key: any, or the first or last by ``arrival``. Null is a key like others.

    Copies are combined on the map side, so a key with very many copies does not fill a task.
    """
    if arrival is None:
        return df.dropDuplicates(list(keys))
    pick = {"first": F.min_by, "last": F.max_by}[keep]
    row = pick(F.struct(*df.columns), arrival).alias("_row")
    return df.groupBy(*keys).agg(row).select(*[F.col("_row")[name].alias(name) for name in df.columns])


def candle_sort(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    """Ascending by time (within ``keys``, if given); a range shuffle, so no task gets all."""
    return df.orderBy(*keys, F.asc(ts))
