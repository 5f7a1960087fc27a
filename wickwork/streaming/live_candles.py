"""Candles kept up to date from a stream of ticks, in whatever order the ticks arrive.

A batch of ticks is reduced to *partial candles*: low, high and sum, and the first and last value
together with the place they were taken from. Two partial candles of one slot merge into one without
the ticks, so the table holds partial candles and every batch is merged into it. A late tick corrects
the candle it belongs to; there is no watermark that would drop it and no streaming state.

Adding up is not repeatable by itself. Each stored candle therefore names the stream and the batch
merged into it last; if a batch runs again after a failure, candles that have it already stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wickwork.functions.frequency import SECOND, floor_div, to_micros
from wickwork.plans.joins import null_safe_join
from wickwork.schema import GRANULARITY_SECONDS, TRIGGER
from wickwork.sources.tables import GRAINS, create_table, partition_column, read_table, upsert
from wickwork.streaming.queries import _writer

CANDLE = ["low", "high", "open", "close", "volume"]
#: Where the first and the last value were taken from, and which batch was merged last.
PLACES, MERGED = ["opened", "closed"], ["stream", "batch"]


def partial_candles(
    ticks: DataFrame,
    value: str = "value",
    ts: str = "ts",
    keys: Sequence[str] = ("symbol",),
    granularity: int = GRANULARITY_SECONDS,
    volume: Column | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """One partial candle per series and slot: ``CANDLE`` and ``PLACES``.

    Ticks of one time are taken in the order of ``order``, and then of their value. ``volume`` must be
    a sum or a count (the default). Everything is combined on the map side. Ticks without a time or
    value have no part in a candle.
    """
    kind, step = ticks.schema[ts].dataType, granularity * SECOND
    slot = F.timestamp_micros(floor_div(to_micros(F.col(ts)), step) * step).cast(kind)
    place = F.struct(F.col(ts).alias("ts"), *order, F.col(value).alias("value"))
    volume = F.count(F.lit(1)).cast("double") if volume is None else volume
    ticks = ticks.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
    made = ticks.groupBy(*keys, slot.alias("_slot")).agg(
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.min(place).alias("opened"),
        F.max(place).alias("closed"),
        volume.alias("volume"),
    )
    return made.select(
        *keys, F.col("_slot").alias(ts), "low", "high", F.col("opened.value").alias("open"), F.col("closed.value").alias("close"), "volume", *PLACES
    )


def merged(candles: DataFrame, ts: str = "ts", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Partial candles of the same slot as one. The order in which they are merged does not matter,
    but for the last digits of a sum of fractions."""
    made = candles.groupBy(*keys, ts).agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min("opened").alias("opened"),
        F.max("closed").alias("closed"),
        F.sum("volume").alias("volume"),
    )
    return made.select(
        *keys, ts, "low", "high", F.col("opened.value").alias("open"), F.col("closed.value").alias("close"), "volume", *PLACES
    )


def candle_table(spark: SparkSession, table: str, partial: T.StructType, ts: str = "ts", grain: str = "day", location: str | None = None) -> bool:
    """Create the table of partial candles with the columns of :func:`partial_candles`."""
    schema = T.StructType([*partial, T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])
    return create_table(spark, table, schema=schema, ts=ts, grain=grain, location=location)


def merge_batch(partial: DataFrame, table: str, stream: str, batch: int, ts: str = "ts", keys: Sequence[str] = ("symbol",)) -> None:
    """Merge a batch of partial candles into the table, once however often it is called.

    Reads the partitions the batch falls into, and writes the candles that it changes.
    """
    spark, grain, keys = partial.sparkSession, partition_column(partial.sparkSession, table), list(keys)
    partial = partial.dropna(how="any", subset=[*keys, ts]).persist()
    try:
        # One row per touched partition.
        parts = [row[0] for row in partial.select(GRAINS[grain](F.col(ts)).alias("part")).distinct().collect()]
        if not parts:
            return
        stored = read_table(spark, table).where(F.col(grain).isin(parts))
        stored = null_safe_join(stored, partial.select(*keys, ts), [*keys, ts], "left_semi").drop(grain)
        has_it = F.coalesce((F.col("stream") == stream) & (F.col("batch") >= batch), F.lit(False))
        done = stored.where(has_it).select(*keys, ts)
        todo = null_safe_join(partial, done, [*keys, ts], "left_anti")
        both = todo.unionByName(stored.where(~has_it).select(*partial.columns))
        changed = merged(both, ts, keys).withColumns({"stream": F.lit(stream), "batch": F.lit(batch).cast("long")})
        upsert(changed, table, [*keys, ts], ts)
    finally:
        partial.unpersist()


def candle_stream(
    ticks: DataFrame,
    table: str,
    name: str,
    value: str = "value",
    ts: str = "ts",
    keys: Sequence[str] = ("symbol",),
    granularity: int = GRANULARITY_SECONDS,
    volume: Column | None = None,
    order: Sequence[str] = (),
    checkpoint: str | None = None,
    trigger: str | None = TRIGGER,
) -> StreamingQuery:
    """Keep the table of :func:`candle_table` up to date from a stream of ticks.

    ``name`` marks what this stream has merged, so it stays with its checkpoint: a stream that starts
    over without one is to get a new table, or it adds the ticks up again. Several streams may feed
    one table, one after the other. Ticks with a null key are left out, as null is no key of a table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(partial_candles(batch, value, ts, keys, granularity, volume, order), table, name, number, ts, keys)

    return _writer(ticks, name, checkpoint, trigger).foreachBatch(merge).start()


def read_candles(spark: SparkSession, table: str, ts: str = "ts", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The candles without what is kept for merging."""
    return read_table(spark, table).select(*keys, ts, *CANDLE)
