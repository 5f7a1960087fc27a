"""One entity's table and the ways to load it, as one object."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wickwork.functions.records import in_declared_order, split_rejects
from wickwork.operators.candles import incremental_filter
from wickwork.schema import GRANULARITY_SECONDS, MAX_CHUNK_HOURS, TRIGGER
from wickwork.session import use_utc
from wickwork.sources import ranges, tables
from wickwork.sources.chunks import check_hours
from wickwork.sources.events import read_events, stream_events
from wickwork.streaming.queries import append_stream, parse_stream, upsert_stream


class CandleLoader:
    """Loads the candles of ``symbol`` into ``[catalog.]database.table``.

    The table is created if it is not there, and loading continues from its latest timestamp
    unless ``start`` says otherwise.
    """

    def __init__(
        self,
        spark: SparkSession,
        table: str,
        database: str = "default",
        catalog: str | None = None,
        symbol: str = "BTC-USD",
        start: str | None = None,
        end: str | None = None,
        granularity: int = GRANULARITY_SECONDS,
        hours: int = MAX_CHUNK_HOURS,
        fmt: str = "parquet",
        grain: str = "year",
        location: str | None = None,
        create: bool = True,
        use_sql: bool = True,
        topic: str | None = None,
        servers: str | None = None,
        event_format: str = "kafka",
    ):
        self.spark = use_utc(spark)
        self.hours = check_hours(hours)
        self.symbol, self.granularity = symbol, granularity
        self.topic, self.servers, self.event_format = topic, servers, event_format
        self.table = ".".join(part for part in (catalog, database, table) if part)
        if create:
            tables.use_namespace(spark, database, catalog)
            tables.create_table(spark, self.table, fmt, grain=grain, location=location, use_sql=use_sql)
        self.resumed = start is None
        self.start = start or self.latest()
        self.end = end

    def latest(self) -> str:
        return tables.latest_mark(self.spark, self.table)

    def until(self) -> str:
        """The given end; else the start of the last candle that is complete by now."""
        now = int(datetime.now(timezone.utc).timestamp()) - self.granularity
        return self.end or datetime.fromtimestamp(now - now % self.granularity, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")

    def _mark(self) -> Column:
        """Rows up to here are loaded already; null if the start was given."""
        return F.to_timestamp(F.lit(self.start if self.resumed else None))

    def _append(self, candles: DataFrame, max_rows_per_file: int | None = None) -> int:
        counted = Observation()
        tables.append(in_declared_order(candles), self.table, max_rows_per_file=max_rows_per_file, observe_as=counted)
        return counted.get["rows"]

    def load_range(self, fetch: str, max_rows_per_file: int | None = None, **options: str) -> int:
        """Fetch the candles from the mark to the end, append them, and return how many they were.

        The next call goes on where this one ended; if nothing came, the mark stays.
        """
        ranges.register(self.spark)
        options = {
            "symbols": self.symbol,
            "start": self.start,
            "end": self.until(),
            "fetch": fetch,
            "granularity": str(self.granularity),
            "hours": str(self.hours),
        } | options
        candles = self.spark.read.format("candle_range").options(**options).load()
        rows = self._append(incremental_filter(candles, self._mark(), "Timestamp", ()), max_rows_per_file)
        if rows:
            self.start, self.resumed = self.latest(), True
        return rows

    def load_events(self, **options: str) -> int:
        """Append what the topic holds now, and return the number of rows."""
        events = read_events(self.spark, self.topic, self.event_format, self.servers, **options)
        good, _ = split_rejects(events)
        return self._append(good)

    def consume(
        self,
        name: str | None = None,
        checkpoint: str | None = None,
        trigger: str | None = TRIGGER,
        merge: bool = True,
        corrections: bool = False,
        **options: str,
    ) -> StreamingQuery:
        """Start the stream from the topic to the table: deduplicated and upserted, or with
        ``merge=False`` appended as it comes. With ``corrections`` no key is remembered, and a
        later event of a key replaces its row."""
        name = name or self.topic
        events = stream_events(self.spark, self.topic, self.event_format, self.servers, **options)
        if merge:
            return upsert_stream(parse_stream(events, distinct=not corrections), self.table, name, checkpoint=checkpoint, trigger=trigger)
        return append_stream(split_rejects(events)[0], self.table, name, checkpoint, trigger)

    def compact(self, values: Sequence, files: int, partition: str = "year") -> None:
        tables.compact(self.spark, self.table, values, files, partition)
