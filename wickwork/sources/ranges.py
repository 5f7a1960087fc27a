"""Candles of a time range, read chunk by chunk through a fetch function.

Two data sources for ``spark.read`` and ``spark.readStream``. The chunks of all symbols are the
input partitions, so they are fetched by the executors side by side, and nothing passes through
the driver but the plan: ``(symbol, start, end)`` per partition. A fetch function is named as
``package.module:function`` and called as ``fetch(symbol, granularity, start, end, options)`` with
epoch seconds; it returns rows ``[epoch seconds, low, high, open, close, volume]`` in any order.

>>> spark.dataSource.register(CandleRange)
>>> spark.read.format("candle_range").options(symbols="BTC-USD", start=..., end=...,
...     fetch="wickwork.sources.ranges:replay", path=...).load()
"""

from __future__ import annotations

import functools
import importlib
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from wickwork.schema import BUFFER_SECONDS, CANDLE_SCHEMA, GRANULARITY_SECONDS, MAX_CHUNK_HOURS
from wickwork.session import ship_package
from wickwork.sources.chunks import check_hours

RANGE_SCHEMA = StructType([StructField("Symbol", StringType(), True), *CANDLE_SCHEMA.fields])
_ARROW_SCHEMA = pa.schema(
    [
        ("Symbol", pa.string()),
        ("Timestamp", pa.timestamp("us", tz="UTC")),
        *[(field.name, pa.float32()) for field in CANDLE_SCHEMA.fields[1:]],
    ]
)


def epoch_seconds(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp())


@dataclass
class ChunkRun(InputPartition):
    """Consecutive chunks of one symbol: times in ``[start, end)``, or to ``end`` itself if
    ``closed``; without ``start`` itself if ``after``."""

    symbol: str
    start: int
    end: int
    closed: bool
    after: bool = False

    def __post_init__(self):
        super().__init__((self.symbol, self.start, self.end))


@dataclass
class RangeOptions:
    """The options of both sources."""

    symbols: list[str]
    fetch: str
    granularity: int
    width: int
    chunks_per_task: int
    given: dict[str, str]

    @classmethod
    def of(cls, options: dict[str, str]) -> RangeOptions:
        given = dict(options)
        return cls(
            [name.strip() for name in given["symbols"].split(",")],
            given["fetch"],
            int(given.get("granularity", GRANULARITY_SECONDS)),
            check_hours(int(given.get("hours", MAX_CHUNK_HOURS))) * 3600,
            int(given.get("chunkspertask", given.get("chunksPerTask", 8))),
            given,
        )

    def runs(self, start: int, end: int, after: bool = False) -> list[ChunkRun]:
        """A few chunks per task: short tasks which balance, yet not one task per request."""
        length = self.width * self.chunks_per_task
        return [
            ChunkRun(symbol, low, min(low + length, end), low + length >= end, after and low == start)
            for low in range(start, end, length)
            for symbol in self.symbols
        ]

    def read(self, run: ChunkRun) -> Iterator[pa.RecordBatch]:
        module, name = self.fetch.split(":")
        fetch = getattr(importlib.import_module(module), name)
        for low in range(run.start, run.end, self.width):
            high = min(low + self.width, run.end)
            closed = run.closed and high == run.end
            first = low + 1 if run.after and low == run.start else low
            rows = [
                row
                for row in fetch(run.symbol, self.granularity, low, high, self.given)
                if first <= row[0] < high or (closed and row[0] == high)
            ]
            if rows:
                yield _batch(run.symbol, sorted(rows, key=lambda row: row[0]))


def _batch(symbol: str, rows: list) -> pa.RecordBatch:
    seconds, *prices = zip(*rows)
    micros = pa.array([int(second) * 1_000_000 for second in seconds], pa.timestamp("us", tz="UTC"))
    columns = [pa.array([symbol] * len(rows)), micros, *[pa.array(price, pa.float64()).cast(pa.float32()) for price in prices]]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW_SCHEMA)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = RangeOptions.of(options)

    def partitions(self):
        given = self.options.given
        return self.options.runs(epoch_seconds(given["start"]), epoch_seconds(given["end"]))

    def read(self, partition):
        return self.options.read(partition) if partition is not None else iter(())


class CandleRange(DataSource):
    """Candles of ``start`` to ``end``, both included; neighbouring chunks share no candle."""

    @classmethod
    def name(cls):
        return "candle_range"

    def schema(self):
        return RANGE_SCHEMA

    def reader(self, schema):
        return RangeReader(self.options)


class FeedReader(DataSourceStreamReader):
    """Polls for candles newer than the last pass. The offset is a time: everything up to it has
    been read. Candles younger than ``buffer`` seconds are left for the next pass, as they may not
    be complete yet. ``end`` stops the clock, for a replay."""

    def __init__(self, options: dict[str, str]):
        self.options = RangeOptions.of(options)
        self.start = epoch_seconds(self.options.given["start"])

    def initialOffset(self):
        return {"until": self.start}

    def latestOffset(self):
        given, step = self.options.given, self.options.granularity
        if "end" in given:
            return {"until": max(self.start, epoch_seconds(given["end"]))}
        # A candle is complete when its whole width has passed.
        until = int(time.time()) - max(int(given.get("buffer", BUFFER_SECONDS)), step)
        return {"until": max(self.start, until - until % step)}

    def partitions(self, start, end):
        # The first pass includes its start; later ones begin after the last candle read.
        low = start["until"]
        return self.options.runs(low, end["until"], after=low > self.start)

    def read(self, partition):
        return self.options.read(partition)

    def commit(self, end):
        pass


class CandleFeed(DataSource):
    """The stream form: each micro-batch has the candles since the one before it."""

    @classmethod
    def name(cls):
        return "candle_feed"

    def schema(self):
        return RANGE_SCHEMA

    def streamReader(self, schema):
        return FeedReader(self.options)


def register(spark) -> None:
    """Make both sources known to the session, and their code to its executors."""
    ship_package(spark)
    spark.dataSource.register(CandleRange)
    spark.dataSource.register(CandleFeed)


@functools.lru_cache(maxsize=8)
def _dataset(path: str) -> ds.Dataset:
    """Listed once per Python worker and path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return ds.dataset(path, format="parquet")


def replay(symbol: str, granularity: int, start: int, end: int, options: dict[str, str]) -> list[list]:
    """Fetch from Parquet candles (symbol, ts, low, high, open, close, volume) below ``path``.

    The filter goes to the Parquet reader, so row groups outside of the chunk are not read.
    """
    table = _dataset(options["path"])
    kind = table.schema.field("ts").type
    low, high = (pa.scalar(at * 1_000_000, pa.timestamp("us")).cast(pa.timestamp("us", tz=kind.tz)).cast(kind) for at in (start, end))
    wanted = (ds.field("symbol") == symbol) & (ds.field("ts") >= low) & (ds.field("ts") <= high)
    found = table.to_table(["ts", "low", "high", "open", "close", "volume"], filter=wanted)
    seconds = [at // 1_000_000 for at in found["ts"].cast(pa.timestamp("us", tz=kind.tz)).cast(pa.int64()).to_pylist()]
    return [list(row) for row in zip(seconds, *[found[name].to_pylist() for name in found.column_names[1:]])]
