"""Streaming ingestion: parse, deduplicate, append or upsert.

Every function takes and returns streaming DataFrames or starts one query. Checkpoints are
``<root>/<query name>``, so each stream has its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wickwork.functions.records import encode_events, split_rejects
from wickwork.operators.candles import dedup
from wickwork.schema import CANDLE_SCHEMA, TRIGGER
from wickwork.session import scratch_root
from wickwork.sources.events import need_servers
from wickwork.sources.tables import partition_column, supports_merge, upsert, with_partition

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on disk, for key sets which do not fit in executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def checkpoint_path(spark: SparkSession, name: str, root: str | None = None) -> str:
    return f"{(root or scratch_root(spark)).rstrip('/')}/checkpoints/{name}"


def dedup_stream(
    df: DataFrame,
    keys: Sequence[str] = ("Timestamp",),
    spread: int = 0,
) -> DataFrame:
    """The first row of each key to arrive, also across batches and restarts.

    Every key is remembered for good, on disk (RocksDB). A watermark would bound the state, but it
    also drops late rows with new keys. To keep no state at all, leave this step out and let the
    table decide: :func:`upsert_stream` with ``update=False`` keeps the first row of a key.
    ``spread`` puts a first step before it, in which copies of one key are shared out among that
    many tasks, for topics where one key makes up much of the traffic.
    """
    use_rocksdb(df.sparkSession)
    keys = list(keys)
    if spread > 1:
        share = F.spark_partition_id() % spread
        df = df.withColumn("_share", share).dropDuplicates([*keys, "_share"]).drop("_share")
    return df.dropDuplicates(keys)


def parse_stream(
    events: DataFrame,
    keys: Sequence[str] = ("Timestamp",),
    schema: T.StructType = CANDLE_SCHEMA,
    spread: int = 0,
    distinct: bool = True,
) -> DataFrame:
    """Events to candles, distinct by key unless :func:`upsert_stream` is to choose among copies;
    events without a usable key are left to :func:`reject_stream`."""
    good, _ = split_rejects(events, schema, keys)
    return dedup_stream(good, keys, spread) if distinct else good


def reject_stream(
    events: DataFrame, schema: T.StructType = CANDLE_SCHEMA, key: str | Sequence[str] = "Timestamp"
) -> DataFrame:
    """The raw events which do not parse to a record with all its keys."""
    return split_rejects(events, schema, key)[1]


def _writer(df: DataFrame, name: str, checkpoint: str | None, trigger: str | None):
    location = checkpoint or checkpoint_path(df.sparkSession, name)
    writer = df.writeStream.queryName(name).outputMode("append").option("checkpointLocation", location)
    # Without a trigger interval: all there is now, in as many batches as it takes, then stop.
    return writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)


def append_stream(
    df: DataFrame,
    table: str,
    name: str,
    checkpoint: str | None = None,
    trigger: str | None = TRIGGER,
    ts: str = "Timestamp",
) -> StreamingQuery:
    """Append a stream to a table."""
    spark = df.sparkSession
    grain = partition_column(spark, table)
    if supports_merge(spark, table):
        return _writer(df, name, checkpoint, trigger).option("fanout-enabled", "true").toTable(table)
    if grain:
        df = with_partition(df, ts, grain)
    df = df.select(*spark.table(table).columns)
    writer = _writer(df, name, checkpoint, trigger).format("parquet")
    return (writer.partitionBy(grain) if grain else writer).toTable(table)


def upsert_stream(
    df: DataFrame,
    table: str,
    name: str,
    keys: Sequence[str] = ("Timestamp",),
    checkpoint: str | None = None,
    trigger: str | None = TRIGGER,
    ts: str = "Timestamp",
    keep: str = "last",
    arrival: str | None = None,
    update: bool = True,
) -> StreamingQuery:
    """Upsert each micro-batch by key. A batch that is run again after a failure has no further
    effect, so every event counts once.

    Copies of a key within a batch are reduced to the ``keep`` one by ``arrival`` (to the largest
    row without it). Corrections in later batches replace the row, unless ``update`` is false: then
    the first row of a key stays, without any streaming state.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = dedup(batch, keys, arrival, keep) if arrival else batch
        upsert(rows, table, keys, ts, update)

    return _writer(df, name, checkpoint, trigger).foreachBatch(merge).start()


def feed_stream(
    candles: DataFrame,
    topic: str,
    name: str,
    fmt: str = "kafka",
    servers: str | None = None,
    checkpoint: str | None = None,
    trigger: str | None = TRIGGER,
) -> StreamingQuery:
    """Send a stream of candles (as :class:`wickwork.sources.ranges.CandleFeed` reads it) to a
    topic as keyed JSON events."""
    writer = _writer(encode_events(candles), name, checkpoint, trigger).format(fmt)
    if fmt == "kafka":
        return writer.option("kafka.bootstrap.servers", need_servers(servers)).option("topic", topic).start()
    return writer.option("path", topic).start()


def start_entities(
    spark: SparkSession,
    config: dict[str, dict],
    start: Callable[[str, dict], StreamingQuery],
) -> dict[str, StreamingQuery]:
    """One query per configured entity. ``start`` gets the entity and its settings."""
    return {entity: start(entity, settings) for entity, settings in config.items()}
