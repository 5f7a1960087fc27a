"""One stream for many topics: one query and one checkpoint feed the tables of all entities.

A query per entity costs a driver thread, a checkpoint and a trigger each, however little there is to
read. Here a batch is read once, and its rows go to the table of their topic. A batch that runs again
is upserted again, which changes nothing.

What a batch brought is counted while it passes, by topic: rows, rejects and the latest time. A
listener adds these counts to a table.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from wickwork.functions.records import bytes_to_text
from wickwork.schema import CANDLE_SCHEMA, EVENT_SCHEMA, TRIGGER
from wickwork.sources.events import need_servers
from wickwork.sources.tables import upsert
from wickwork.streaming.queries import _writer

PROGRESS = "stream string, batch bigint, topic string, rows bigint, rejects bigint, latest timestamp"
METRICS = "by_topic"


def stream_topics(
    spark: SparkSession, topics: Sequence[str], fmt: str = "kafka", servers: str | None = None, root: str | None = None, **options: str
) -> DataFrame:
    """The events of several topics as one stream: ``topic``, ``key``, ``value``, from the earliest on.

    A replay is a folder ``root`` with one ``topic=<name>`` folder of files for each topic.
    """
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {"kafka.bootstrap.servers": need_servers(servers), "subscribe": ",".join(topics), "startingOffsets": "earliest"} | options
        events = reader.options(**options).load()
    else:
        events = reader.schema(T.StructType([*EVENT_SCHEMA, T.StructField("topic", T.StringType())])).options(**options).load(root)
        events = events.where(F.col("topic").isin(list(topics)))
    return events.select("topic", "key", "value")


def write_topics(events: DataFrame, root: str, fmt: str = "parquet") -> None:
    """Add events (``topic``, ``key``, ``value``) to the folders of a replay."""
    events.write.format(fmt).mode("append").partitionBy("topic").save(root)


def parsed_topics(events: DataFrame, schema: T.StructType = CANDLE_SCHEMA, keys: Sequence[str] = ("Timestamp",)) -> DataFrame:
    """``topic``, ``data`` (the record) and ``good``: whether it has all its keys."""
    parsed = events.select("topic", F.from_json(bytes_to_text(F.col("value")), schema).alias("data"))
    good: Column = F.lit(True)
    for key in keys:
        good = good & F.col(f"data.{key}").isNotNull()
    return parsed.withColumn("good", good)


def counted(parsed: DataFrame, topics: Sequence[str], ts: str = "Timestamp") -> DataFrame:
    """The rows, counted by topic while they pass, without reading them again."""
    metrics = []
    for i, topic in enumerate(topics):
        mine = F.col("topic") == topic
        metrics += [
            F.count_if(mine & F.col("good")).alias(f"rows_{i}"),
            F.count_if(mine & ~F.col("good")).alias(f"rejects_{i}"),
            F.max(F.when(mine & F.col("good"), F.col(f"data.{ts}"))).alias(f"latest_{i}"),
        ]
    return parsed.observe(METRICS, *metrics)


def fanout_stream(
    events: DataFrame,
    tables: Mapping[str, str],
    name: str,
    schema: T.StructType = CANDLE_SCHEMA,
    keys: Sequence[str] = ("Timestamp",),
    ts: str = "Timestamp",
    checkpoint: str | None = None,
    trigger: str | None = TRIGGER,
    update: bool = True,
) -> StreamingQuery:
    """Upsert each topic's events into its table; ``tables`` says which. Events that do not parse to a
    record with all its keys are counted as rejects and left out."""
    topics = list(tables)
    parsed = counted(parsed_topics(events, schema, keys), topics, ts)

    def route(batch: DataFrame, number: int) -> None:
        batch = batch.where("good").persist()
        try:
            # What the batch has; as many names as there are topics at most.
            there = {row[0] for row in batch.select("topic").distinct().collect()}
            for topic, table in tables.items():
                if topic in there:
                    upsert(batch.where(F.col("topic") == topic).select("data.*"), table, keys, ts, update)
        finally:
            batch.unpersist()

    return _writer(parsed, name, checkpoint, trigger).foreachBatch(route).start()


class ProgressTable(StreamingQueryListener):
    """Adds a row per batch and topic to a table of files with the columns ``PROGRESS``.

    A batch that ran again is there again; take the last of its rows, or any: they are equal. Add it with
    ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, topics: Sequence[str]):
        self.spark, self.path, self.name, self.topics = spark, path, name, list(topics)
        self.run: str | None = None
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = str(event.runId)
            self.ended.clear()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(METRICS) if progress.name == self.name else None
        if seen is None or not progress.numInputRows:
            return
        rows = [
            (self.name, progress.batchId, topic, seen[f"rows_{i}"], seen[f"rejects_{i}"], seen[f"latest_{i}"])
            for i, topic in enumerate(self.topics)
        ]
        self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.ended.set()


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Per stream and topic: rows and rejects of all its batches, and the latest time. Each batch counts once."""
    batches = spark.read.schema(PROGRESS).parquet(path).dropDuplicates(["stream", "batch", "topic"])
    return batches.groupBy("stream", "topic").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), F.sum("rejects").alias("rejects"), F.max("latest").alias("latest")
    )
