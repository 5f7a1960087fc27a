"""Keyed events of a topic: bounded and streaming reads, writes, a peek.

The format is a parameter. ``kafka`` needs the connector on the class path; a folder of files with
the same binary ``key`` and ``value`` columns serves as a replay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickwork.schema import EVENT_SCHEMA


def need_servers(servers: str | None) -> str:
    if not servers:
        raise ValueError("the address of the topic's servers is missing")
    return servers


def _options(fmt: str, topic: str, servers: str | None, more: dict[str, str]) -> dict[str, str]:
    if fmt != "kafka":
        return more
    return {"kafka.bootstrap.servers": need_servers(servers), "subscribe": topic} | more


def _load(reader, fmt: str, topic: str, servers: str | None, options: dict[str, str]) -> DataFrame:
    reader = reader.format(fmt).options(**_options(fmt, topic, servers, options))
    return reader.load() if fmt == "kafka" else reader.schema(EVENT_SCHEMA).load(topic)


def read_events(spark: SparkSession, topic: str, fmt: str = "kafka", servers: str | None = None, **options: str) -> DataFrame:
    """All events of a topic up to now."""
    return _load(spark.read, fmt, topic, servers, options)


def stream_events(spark: SparkSession, topic: str, fmt: str = "kafka", servers: str | None = None, **options: str) -> DataFrame:
    """The events of a topic as a stream, from the earliest on. Set ``maxOffsetsPerTrigger`` (or
    ``maxFilesPerTrigger``) to bound the first micro-batches over a long history."""
    if fmt == "kafka":
        options = {"startingOffsets": "earliest"} | options
    return _load(spark.readStream, fmt, topic, servers, options)


def write_events(events: DataFrame, topic: str, fmt: str = "kafka", servers: str | None = None) -> None:
    """Send events to a topic, or add them to its replay folder."""
    if fmt == "kafka":
        options = {"kafka.bootstrap.servers": need_servers(servers), "topic": topic}
        events.write.format(fmt).options(**options).save()
    else:
        events.write.format(fmt).mode("append").save(topic)


def peek(events: DataFrame) -> DataFrame:
    """Keys and values as text."""
    return events.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def landing_scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The given columns of the Parquet files in a landing zone; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)
