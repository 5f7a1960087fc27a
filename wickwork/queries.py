"""Every operator as a query over the given tables, with its equivalent in SQL.

``events`` are taken as ticks (symbol = event type), from which hourly or minute candles are made;
``orders``, which cover several years, serve where partitions and dates matter. Results are
scalars, so that another engine's can be compared with them. Queries which write do so in a new
place below the shared scratch folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wickwork.functions import records
from wickwork.operators import candles as cd
from wickwork.operators import fills, frames
from wickwork.schema import CANDLE_COLUMNS, ENTITY_MARKS, FLUSH_ROWS
from wickwork.session import scratch_path, use_utc
from wickwork.sources import events as ev
from wickwork.sources import ranges, tables
from wickwork.sources.chunks import range_chunks
from wickwork.streaming import fanout, live_candles, monotonic
from wickwork.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PRICES = ["low", "high", "open", "close", "volume"]
WIRE = ["Symbol", *CANDLE_COLUMNS]


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(use_utc(spark), sf_dir)
        ORACLES[fn.__name__] = sql
        return fn

    return add


# Inputs ---------------------------------------------------------------------------------------


# Declared, so that no job has to open files to find them out.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string"
)


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("symbol"), "ts", "value", "event_id", "user_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cd.ohlcv_candles(ticks(spark, sf_dir), granularity=3600)


def minutely(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cd.ohlcv_candles(ticks(spark, sf_dir), granularity=60)


def patchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute candles; the close is null in every third minute."""
    close = F.when(F.minute("ts") % 3 != 0, F.col("close"))
    return minutely(spark, sf_dir).withColumn("close", close)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated prices per priority: several rows per day, those of every seventh day of a
    year moved to the day before, and no price for some."""
    orders = orders_of(spark, sf_dir)
    gap = F.when(F.dayofyear("o_orderdate") % 7 == 0, 1).otherwise(0)
    orders = orders.withColumn("o_orderdate", (F.col("o_orderdate") - F.make_interval(days=gap)).cast("timestamp_ntz"))
    price = F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice"))
    return orders.select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ds"), price.alias("y"), "o_orderkey"
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candle per day, all orders together."""
    orders = orders_of(spark, sf_dir).withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    days = cd.ohlcv_candles(orders, "o_totalprice", "ts", (), 86_400, order=["o_orderkey"])
    return days.select(F.col("ts").alias("Timestamp"), *[F.col(name).alias(name.title()) for name in PRICES])


def wire(candles: DataFrame) -> DataFrame:
    """Candles under the names and types of the wire: single precision, zoned timestamps."""
    return candles.select(
        F.col("symbol").alias("Symbol"),
        F.col("ts").cast("timestamp").alias("Timestamp"),
        *[F.col(name).cast("float").alias(name.title()) for name in PRICES],
    )


def plain(df: DataFrame) -> DataFrame:
    """Lower-case names, double precision, and timestamps without zone."""
    types = {"timestamp": "timestamp_ntz", "float": "double"}
    return df.select(*[F.col(name).cast(types.get(kind, kind)).alias(name.lower()) for name, kind in df.dtypes])


def new_table(spark: SparkSession, name: str, schema=ranges.RANGE_SCHEMA, **options) -> str:
    table = f"wick_{name}_{uuid.uuid4().hex[:12]}"
    tables.create_table(spark, table, schema=schema, location=scratch_path(spark, name), **options)
    return table


def topic_of(spark: SparkSession, name: str, events: DataFrame) -> str:
    """A replay topic holding the events."""
    path = scratch_path(spark, name)
    ev.write_events(events, path, "parquet")
    return path


def encoded(candles: DataFrame) -> DataFrame:
    return records.encode_events(wire(candles), fields=WIRE)


def with_malformed(events: DataFrame) -> DataFrame:
    """Add, for every event, one whose value is cut short, and one with a bad timestamp."""
    text = F.col("value").cast("string")
    cut = text.substr(F.lit(1), F.length(text) - 5).cast("binary")
    bad = F.regexp_replace(text, '"Timestamp":"[^"]*"', '"Timestamp":"none"').cast("binary")
    broken = events.select("key", F.explode(F.array(cut, bad)).alias("value"))
    return events.unionByName(broken)


def candle_sql(unit: str) -> str:
    return f"""
    SELECT event_type AS symbol, date_trunc('{unit}', ts) AS ts, min(value) AS low, max(value) AS high,
           arg_min(value, ts) AS open, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
    FROM events GROUP BY 1, 2"""


CH, CM = candle_sql("hour"), candle_sql("minute")
PATCHY = f"""SELECT symbol, ts, low, high, open, CASE WHEN minute(ts) % 3 <> 0 THEN close END AS close, volume FROM ({CM})"""
SINGLE = ", ".join(f"CAST(CAST({name} AS REAL) AS DOUBLE) AS {name}" for name in PRICES)
WIRE_SQL = f"SELECT symbol, ts AS timestamp, {SINGLE} FROM ({CH})"
SPINE_M = f"""
    SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 MINUTE)) AS ts
    FROM (SELECT symbol, min(ts) AS a, max(ts) AS b FROM ({CM}) GROUP BY symbol)"""
PRICES_SQL = """
    SELECT o_orderpriority AS symbol,
           CASE WHEN dayofyear(o_orderdate) % 7 = 0 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate END AS ds,
           CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS y, o_orderkey
    FROM orders"""
DAY_SPINE = f"""
    SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ds
    FROM (SELECT symbol, min(ds) AS a, max(ds) AS b FROM ({PRICES_SQL}) GROUP BY symbol)"""
DAILY_SQL = """
    SELECT o_orderdate AS timestamp, min(o_totalprice) AS low, max(o_totalprice) AS high,
           arg_min(o_totalprice, o_orderkey) AS open, arg_max(o_totalprice, o_orderkey) AS close,
           CAST(count(*) AS DOUBLE) AS volume
    FROM orders GROUP BY 1"""


# Sources and sinks ------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def landing_scan(spark, sf_dir):
    return ev.landing_scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_orderdate", "o_totalprice"])


@query(WIRE_SQL)
def table_roundtrip(spark, sf_dir):
    table = new_table(spark, "roundtrip")
    tables.append(wire(hourly(spark, sf_dir)), table)
    return plain(tables.read_table(spark, table).select(*WIRE))


@query(WIRE_SQL)
def batch_from_kafka_json(spark, sf_dir):
    topic = topic_of(spark, "topic", encoded(hourly(spark, sf_dir)))
    events = ev.read_events(spark, topic, "parquet")
    return plain(records.in_declared_order(records.parse_events(events, ranges.RANGE_SCHEMA), ranges.RANGE_SCHEMA))


def _replay(spark, sf_dir) -> dict[str, str]:
    """Hourly candles as files for the replay fetch, sorted so that a chunk touches few of them."""
    ranges.register(spark)
    path = scratch_path(spark, "replay")
    rows = hourly(spark, sf_dir)
    rows.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts").write.parquet(path)
    bounds = spark.read.parquet(path).agg(F.min("ts"), F.max("ts"), F.collect_set("symbol")).first()
    return {
        "symbols": ",".join(sorted(bounds[2])),
        "start": str(bounds[0]),
        "end": str(bounds[1]),
        "fetch": "wickwork.sources.ranges:replay",
        "path": path,
    }


@query(WIRE_SQL)
def chunked_range_read(spark, sf_dir):
    options = _replay(spark, sf_dir)
    return plain(spark.read.format("candle_range").options(**options).load())


@query(WIRE_SQL)
def stream_feed(spark, sf_dir):
    options = _replay(spark, sf_dir)
    candles = spark.readStream.format("candle_feed").options(**options).load()
    topic = scratch_path(spark, "fed")
    writer = records.encode_events(candles, fields=WIRE).writeStream.format("parquet")
    fed = writer.option("path", topic).option("checkpointLocation", scratch_path(spark, "feed"))
    fed.trigger(availableNow=True).start().awaitTermination()
    return plain(records.parse_events(ev.read_events(spark, topic, "parquet"), ranges.RANGE_SCHEMA))


@query(WIRE_SQL)
def append_batch(spark, sf_dir):
    table = new_table(spark, "append")
    tables.append(wire(hourly(spark, sf_dir)), table, max_rows_per_file=FLUSH_ROWS)
    return plain(tables.read_table(spark, table).select(*WIRE))


@query(f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS key, symbol, ts AS timestamp, {SINGLE} FROM ({CH})")
def event_json_encode(spark, sf_dir):
    events = encoded(hourly(spark, sf_dir)).withColumn("key", F.col("key").cast("string"))
    return plain(records.parse_events(events, ranges.RANGE_SCHEMA, keep=("key",)))


@query(
    "SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS key, '{\"Timestamp\":\"' || strftime(o_orderdate, "
    "'%Y-%m-%d %H:%M:%S') || '\",\"Volume\":' || o_orderkey || '}' AS value FROM orders"
)
def topic_peek(spark, sf_dir):
    orders = orders_of(spark, sf_dir)
    dated = orders.select(F.col("o_orderdate").cast("timestamp").alias("Timestamp"), F.col("o_orderkey").alias("Volume"))
    return ev.peek(records.encode_events(dated, fields=["Timestamp", "Volume"]))


YEARS_SQL = "SELECT o_orderkey, o_orderdate AS timestamp, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders"


def _orders_table(spark, sf_dir, name, appends: int = 1) -> str:
    orders = orders_of(spark, sf_dir)
    rows = orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("Timestamp"), "o_totalprice")
    table = new_table(spark, name, rows.schema)
    for part in range(appends):
        tables.append(rows.where(F.pmod("o_orderkey", F.lit(appends)) == part), table)
    return table


@query(YEARS_SQL)
def year_partitioned_table(spark, sf_dir):
    return plain(tables.read_table(spark, _orders_table(spark, sf_dir, "years")))


@query(f"SELECT * FROM ({YEARS_SQL}) WHERE timestamp >= '1996-03-01' AND timestamp < '1997-09-01'")
def table_range_scan(spark, sf_dir):
    table = _orders_table(spark, sf_dir, "range")
    return plain(tables.read_range(spark, table, "1996-03-01", "1997-09-01"))


@query(YEARS_SQL)
def compact_partition(spark, sf_dir):
    table = _orders_table(spark, sf_dir, "compact", appends=2)
    tables.compact(spark, table, [1996, 1997], files=2)
    return plain(tables.read_table(spark, table))


HOT = "CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '1996-06-01' ELSE o_orderdate END"


@query(
    f"""
    SELECT CAST(year(t) AS INTEGER) AS year, count(*) AS rows, max(t) AS latest, sum(o_orderkey) AS keys, CAST(4 AS BIGINT) AS files, true AS even
    FROM (SELECT o_orderkey, {HOT} AS t FROM orders) WHERE year(t) IN (1996, 1997) GROUP BY 1"""
)
def compact_hot_time(spark, sf_dir):
    """A third of all rows have one time; the files of a year differ by a fifth of their rows at most."""
    orders = orders_of(spark, sf_dir)
    rows = orders.select("o_orderkey", F.expr(HOT).cast("timestamp").alias("Timestamp"), "o_totalprice")
    table = new_table(spark, "hot", rows.schema)
    tables.append(rows, table)
    tables.compact(spark, table, [1996, 1997], files=4)
    done = tables.read_table(spark, table).where(F.col("year").isin(1996, 1997))
    each = done.withColumn("file", F.col("_metadata.file_path")).groupBy("year", "file").agg(
        F.count(F.lit(1)).alias("n"), F.max("Timestamp").alias("latest"), F.sum("o_orderkey").alias("keys")
    )
    mean = F.sum("n") / F.count(F.lit(1))
    even = (F.max("n") <= 1.2 * mean) & (F.min("n") >= 0.8 * mean)
    whole = each.groupBy("year").agg(
        F.sum("n").alias("rows"), F.max("latest").alias("latest"), F.sum("keys").alias("keys"), F.count(F.lit(1)).alias("files"), even.alias("even")
    )
    return plain(whole)


@query("SELECT min(o_orderdate) AS min_ts, max(o_orderdate) AS max_ts FROM orders")
def table_bounds(spark, sf_dir):
    return plain(tables.table_bounds(spark, _orders_table(spark, sf_dir, "bounds")))


@query(
    f"""
    WITH t AS (SELECT * FROM ({DAILY_SQL}) WHERE timestamp < '1999-01-01'),
         s AS (SELECT timestamp, low, high + 1 AS high, open, close, volume FROM ({DAILY_SQL}) WHERE timestamp >= '1998-07-01')
    SELECT coalesce(s.timestamp, t.timestamp) AS timestamp, coalesce(s.low, t.low) AS low,
           coalesce(s.high, t.high) AS high, coalesce(s.open, t.open) AS open, coalesce(s.close, t.close) AS close,
           coalesce(s.volume, t.volume) AS volume
    FROM t FULL JOIN s ON t.timestamp = s.timestamp"""
)
def upsert_by_timestamp(spark, sf_dir):
    days = daily(spark, sf_dir)
    table = new_table(spark, "upsert", days.schema)
    tables.append(days.where(F.col("Timestamp") < "1999-01-01"), table)
    tables.upsert(days.where(F.col("Timestamp") >= "1998-07-01").withColumn("High", F.col("High") + 1), table)
    return plain(tables.read_table(spark, table).drop("year"))


# Projections and filters ------------------------------------------------------------------------


@query(WIRE_SQL)
def json_parse_candle(spark, sf_dir):
    good, _ = records.split_rejects(with_malformed(encoded(hourly(spark, sf_dir))), ranges.RANGE_SCHEMA)
    return plain(good)


@query(f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS key, count(*) * 2 AS rejects FROM ({CH}) GROUP BY 1")
def json_rejects(spark, sf_dir):
    _, rejects = records.split_rejects(with_malformed(encoded(hourly(spark, sf_dir))), ranges.RANGE_SCHEMA)
    return rejects.groupBy(F.col("key").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rejects"))


@query(f"SELECT ts AS timestamp, {SINGLE}, 'BTC-USD' AS symbol, strftime(ts, '%Y') AS year FROM ({CH})")
def candle_enrich(spark, sf_dir):
    rows = wire(hourly(spark, sf_dir))
    return plain(records.enrich(records.in_declared_order(rows), "BTC-USD"))


@query(f"SELECT symbol, ts AS timestamp, {SINGLE} FROM ({CH})")
def array_to_candle(spark, sf_dir):
    values = F.array(F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"), *PRICES)
    arrays = hourly(spark, sf_dir).select("symbol", values.alias("wire"))
    return plain(arrays.select("symbol", records.array_to_candle(F.col("wire")).alias("c")).select("symbol", "c.*"))


@query(
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, date_trunc('second', ts) AS back,
           CAST(NULL AS TIMESTAMP) AS none FROM events"""
)
def timestamp_text(spark, sf_dir):
    text = records.timestamp_to_text(F.col("ts").cast("timestamp"))
    rows = ticks(spark, sf_dir).select("event_id", text.alias("text"))
    back = records.text_to_timestamp(F.col("text"))
    none = records.text_to_timestamp(F.concat(F.lit("x"), "text"), None)
    return plain(rows.select("event_id", "text", back.alias("back"), none.alias("none")))


@query("SELECT event_id, upper(event_type || '-USD') AS symbol FROM events")
def symbol_of_entity(spark, sf_dir):
    return ticks(spark, sf_dir).select("event_id", records.symbol_of_entity(F.col("symbol")).alias("symbol"))


CUTS_SQL = "SELECT event_type, max(ts) AS mark FROM events WHERE user_id % 3 = 0 AND ts < '2024-01-20' AND event_type <> 'view' GROUP BY 1"


@query(
    f"""
    SELECT event_type AS symbol, ts, value FROM events LEFT JOIN ({CUTS_SQL}) m USING (event_type)
    WHERE mark IS NULL OR ts > mark"""
)
def incremental_filter(spark, sf_dir):
    rows = ticks(spark, sf_dir)
    loaded = rows.where((F.col("user_id") % 3 == 0) & (F.col("ts") < "2024-01-20") & (F.col("symbol") != "view"))
    marks = loaded.groupBy("symbol").agg(F.max("ts").alias("mark"))
    return cd.incremental_filter(rows.select("symbol", "ts", "value"), marks)


@query(
    """
    SELECT symbol, event_id, value FROM (
        SELECT event_type AS symbol, event_id, value, max(value) OVER (
            PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
        FROM events)
    WHERE m IS NULL OR value > m"""
)
def monotonic_filter(spark, sf_dir):
    rows = ticks(spark, sf_dir).select("symbol", "event_id", "value")
    return cd.monotonic_filter(rows, ts="value", arrival="event_id", block=1024)


# Aggregations -----------------------------------------------------------------------------------


@query(f"SELECT symbol, ts, {', '.join(PRICES)} FROM ({CH})")
def ohlcv_candles(spark, sf_dir):
    return hourly(spark, sf_dir)


@query(f"SELECT symbol, ts, {', '.join(PRICES)} FROM ({CM})")
def ohlcv_minute_candles(spark, sf_dir):
    return minutely(spark, sf_dir)


@query("SELECT coalesce(strftime(max(ts), '%Y-%m-%d %H:%M:%S'), '2014-01-01 00:00:00') AS latest FROM events")
def latest_timestamp(spark, sf_dir):
    return cd.latest_timestamp(ticks(spark, sf_dir))


@query("SELECT coalesce(strftime(max(ts), '%Y-%m-%d %H:%M:%S'), '2014-01-01 00:00:00') AS latest FROM events WHERE value < 0")
def latest_timestamp_default(spark, sf_dir):
    return cd.latest_timestamp(ticks(spark, sf_dir).where("value < 0"))


@query(
    """
    SELECT d.symbol, strftime(coalesce(m.mark, d.ts), '%Y-%m-%d %H:%M:%S') AS latest
    FROM (SELECT * FROM (VALUES ('btc', TIMESTAMP '2015-07-20 21:37:00'), ('eth', TIMESTAMP '2016-05-18 00:14:00'))
          UNION ALL SELECT DISTINCT event_type, TIMESTAMP '2016-05-18 00:14:00' FROM events) d(symbol, ts)
    LEFT JOIN (SELECT event_type AS symbol, max(ts) AS mark FROM events GROUP BY 1) m ON d.symbol = m.symbol"""
)
def latest_per_symbol(spark, sf_dir):
    """Every symbol of the table has a default, and so have two that are not in it."""
    rows = ticks(spark, sf_dir)
    seen = rows.select("symbol", F.to_timestamp(F.lit(ENTITY_MARKS["eth"])).alias("default_ts")).distinct()
    return cd.latest_per_symbol(rows, tables.entity_defaults(spark, ENTITY_MARKS).unionByName(seen))


@query("SELECT event_type AS symbol, min(ts) AS min_ts, max(ts) AS max_ts FROM events GROUP BY 1")
def series_bounds(spark, sf_dir):
    return fills.series_bounds(ticks(spark, sf_dir))


@query(f"SELECT count(*) AS loaded FROM ({CH})")
def load_count(spark, sf_dir):
    counted = Observation()
    tables.append(wire(hourly(spark, sf_dir)), new_table(spark, "count"), observe_as=counted)
    return spark.range(1).select(F.lit(counted.get["rows"]).cast("bigint").alias("loaded"))


@query("SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2")
def dedup_keep_last(spark, sf_dir):
    orders = orders_of(spark, sf_dir).select("o_custkey", "o_orderdate", "o_totalprice")
    return cd.dedup(orders, ["o_custkey", "o_orderdate"], arrival="o_totalprice", keep="last")


@query("SELECT event_type AS symbol, ts, value FROM events")
def dedup_by_timestamp(spark, sf_dir):
    rows = ticks(spark, sf_dir).select("symbol", "ts", "value")
    return cd.dedup(rows.unionByName(rows), ["ts"])


@query("SELECT event_id, ts, value FROM events ORDER BY ts")
def candle_sort(spark, sf_dir):
    return cd.candle_sort(ticks(spark, sf_dir).select("event_id", "ts", "value"))


@query(
    """
    SELECT event_type AS symbol, max(ts) AS latest, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 1000000.0::DOUBLE AS lag_seconds,
           epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts)) < 60000000 AS fresh FROM events GROUP BY 1"""
)
def freshness(spark, sf_dir):
    return cd.freshness(ticks(spark, sf_dir), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


# Generators and gap fills -----------------------------------------------------------------------


@query(
    """
    SELECT symbol, a AS start, least(a + INTERVAL 5 HOUR, e) AS "end" FROM (
        SELECT event_type AS symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 5 HOUR)) AS a, max(ts) AS e
        FROM events GROUP BY 1) WHERE a < e"""
)
def range_chunks_per_symbol(spark, sf_dir):
    bounds = fills.series_bounds(ticks(spark, sf_dir))
    return range_chunks(bounds.select("symbol", F.col("min_ts").alias("start"), F.col("max_ts").alias("end")))


QUERIES["range_chunks"] = QUERIES.pop("range_chunks_per_symbol")
ORACLES["range_chunks"] = ORACLES.pop("range_chunks_per_symbol")


@query(SPINE_M)
def date_spine(spark, sf_dir):
    return fills.date_spine(minutely(spark, sf_dir), freq="min")


@query(
    """
    SELECT symbol, unnest(list_filter(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH), lambda x: x >= a)) AS ds
    FROM (SELECT o_orderpriority AS symbol, min(o_orderdate) + INTERVAL 10 DAY AS a, max(o_orderdate) + INTERVAL 10 DAY AS b
          FROM orders GROUP BY 1)"""
)
def date_spine_months(spark, sf_dir):
    """The dates are moved by ten days, so that the series begin within a month."""
    moved = (F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")).cast("timestamp_ntz")
    dated = orders_of(spark, sf_dir).select(F.col("o_orderpriority").alias("symbol"), moved.alias("ds"))
    return fills.date_spine(dated, "ds", freq="MS")


@query(f"SELECT s.symbol, s.ts, c.close, c.volume FROM ({SPINE_M}) s LEFT JOIN ({CM}) c ON s.symbol = c.symbol AND s.ts = c.ts")
def spine_left_join(spark, sf_dir):
    rows = minutely(spark, sf_dir).select("symbol", "ts", "close", "volume")
    return fills.spine_left_join(rows, "ts", freq="min", regular=True)


@query(f"SELECT s.symbol, s.ds, p.y, p.o_orderkey FROM ({DAY_SPINE}) s LEFT JOIN ({PRICES_SQL}) p ON s.symbol = p.symbol AND s.ds = p.ds")
def spine_left_join_copies(spark, sf_dir):
    return fills.spine_left_join(prices(spark, sf_dir))


@query(
    f"""
    SELECT symbol, ts, volume, last_value(close IGNORE NULLS) OVER (
        PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
    FROM ({SPINE_M}) s LEFT JOIN ({PATCHY}) c USING (symbol, ts)"""
)
def gapfill_forward(spark, sf_dir):
    rows = patchy(spark, sf_dir).select("symbol", "ts", "volume", "close")
    return fills.fill_forward(rows, "close", "ts", freq="min", regular=True)


FILLED_DAYS = f"""
    SELECT symbol, ds, last_value(y IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f,
           first_value(y IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
    FROM ({DAY_SPINE}) s LEFT JOIN (SELECT symbol, ds, max(y) AS y FROM ({PRICES_SQL}) GROUP BY 1, 2) d USING (symbol, ds)
    WINDOW w AS (PARTITION BY symbol ORDER BY ds)"""


@query(f"SELECT symbol, CAST(ds AS DATE) AS ds, coalesce(p.y, f.f) AS y, o_orderkey FROM ({FILLED_DAYS}) f LEFT JOIN ({PRICES_SQL}) p USING (symbol, ds)")
def gapfill_forward_daily(spark, sf_dir):
    return fills.fill_forward(prices(spark, sf_dir), to_day=True)


@query(
    f"""
    SELECT symbol, ts, volume, coalesce(
        first_value(close IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        last_value(close IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS close
    FROM ({SPINE_M}) s LEFT JOIN ({PATCHY}) c USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts)"""
)
def gapfill_backward(spark, sf_dir):
    rows = patchy(spark, sf_dir).select("symbol", "ts", "volume", "close")
    return fills.fill_backward(rows, "close", "ts", freq="min", regular=True)


@query(f"SELECT symbol, ds, coalesce(p.y, f.b, f.f) AS y, o_orderkey FROM ({FILLED_DAYS}) f LEFT JOIN ({PRICES_SQL}) p USING (symbol, ds)")
def gapfill_backward_daily(spark, sf_dir):
    return fills.fill_backward(prices(spark, sf_dir))


ASOF_M = f"SELECT s.symbol, s.ts, {{}} FROM ({SPINE_M}) s ASOF JOIN ({PATCHY}) c ON s.symbol = c.symbol AND c.ts >= s.ts"


@query(ASOF_M.format("c.open, c.close, c.volume"))
def asof_next(spark, sf_dir):
    rows = patchy(spark, sf_dir).select("symbol", "ts", "open", "close", "volume")
    return fills.asof_next(rows, "ts", freq="min", regular=True)


@query(
    """
    SELECT s.symbol, s.ts, e.value, e.event_id FROM (
        SELECT event_type AS symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 20 MINUTE)) AS ts FROM events GROUP BY 1) s
    ASOF JOIN events e ON s.symbol = e.event_type AND e.ts >= s.ts"""
)
def asof_next_ticks(spark, sf_dir):
    return fills.asof_next(ticks(spark, sf_dir).drop("user_id"), "ts", freq="20min")


@query(
    f"""
    SELECT symbol, ts, open, volume, last_value(close IGNORE NULLS) OVER (
        PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
    FROM ({ASOF_M.format("c.open, c.close, c.volume")})"""
)
def gapfill_row(spark, sf_dir):
    rows = patchy(spark, sf_dir).select("symbol", "ts", "open", "close", "volume")
    return fills.fill_rows(rows, "ts", freq="min", regular=True)


# Supervised framing -----------------------------------------------------------------------------

W = "OVER (PARTITION BY symbol ORDER BY ts)"


def _lags(name: str, numbers, alias: str) -> str:
    """``name`` of so many rows behind (negative: ahead), as numbered columns."""
    return ", ".join(f"lag({name}, {by}) {W} AS {alias.format(i + 1)}" for i, by in enumerate(numbers))


def _complete(columns: str, first: str, last: str) -> str:
    return f"SELECT * EXCLUDE (a_, b_) FROM (SELECT symbol, ts, {columns}, {first} AS a_, {last} AS b_ FROM ({CH})) WHERE a_ IS NOT NULL AND b_ IS NOT NULL"


@query(
    f"""
    SELECT symbol, ts, close, volume, lag(close, 1) {W} AS close_lag1, lag(volume, 1) {W} AS volume_lag1,
           lag(close, 3) {W} AS close_lag3, lag(volume, 3) {W} AS volume_lag3, lead(close, 2) {W} AS close_lead2,
           lead(volume, 2) {W} AS volume_lead2 FROM ({CH})"""
)
def lag_lead(spark, sf_dir):
    return frames.lag_lead(hourly(spark, sf_dir), ["close", "volume"], [1, 3], [2])


@query(_complete(_lags("close", range(3, 0, -1), "x_{}") + ", " + _lags("close", [0, -1], "y_{}"), f"lag(ts, 3) {W}", f"lead(ts, 1) {W}"))
def seq_univariate(spark, sf_dir):
    return frames.flatten(frames.univariate(hourly(spark, sf_dir), "close", 3, 2), 3, 2)


@query(
    _complete(
        _lags("close", range(3, -1, -1), "x_{}_close") + ", " + _lags("volume", range(3, -1, -1), "x_{}_volume") + ", high AS y",
        f"lag(ts, 3) {W}",
        f"lead(ts, 1) {W}",
    )
)
def seq_classification(spark, sf_dir):
    samples = frames.classification(hourly(spark, sf_dir), ["close", "volume"], "high", 4)
    return frames.flatten(samples, 4, 1, ["close", "volume"])


@query(
    _complete(
        _lags("close", range(4, 0, -1), "x_{}_close") + ", " + _lags("volume", range(4, 0, -1), "x_{}_volume") + ", " + _lags("volume", [0, -1, -2], "y_{}"),
        f"lag(ts, 4) {W}",
        f"lead(ts, 2) {W}",
    )
)
def seq_forecast(spark, sf_dir):
    return frames.flatten(frames.forecast(hourly(spark, sf_dir), ["close", "volume"], 4, 3), 4, 3, ["close", "volume"])


@query(
    f"""
    SELECT symbol, ts, {", ".join(f"lag(close, {61 - i}) {W} AS x_{i}" for i in range(1, 61))}, close AS y_1
    FROM (SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (
              PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
          FROM ({SPINE_M}) s LEFT JOIN ({PATCHY}) c USING (symbol, ts))
    QUALIFY lag(ts, 60) {W} IS NOT NULL"""
)
def seq_forecast_filled(spark, sf_dir):
    """The whole way: ticks, minute candles, gap fill, samples of 60 minutes."""
    rows = patchy(spark, sf_dir).select("symbol", "ts", "close")
    filled = fills.fill_forward(rows, "close", "ts", freq="min", regular=True)
    samples = frames.univariate(filled, "close", 60, 1, gap_free="min")
    return frames.flatten(samples, 60, 1)


@query(
    _complete(
        _lags("low", range(3, -1, -1), "x_{}_low") + ", " + _lags("high", range(3, -1, -1), "x_{}_high") + ", " + _lags("close", [0, -1, -2], "y_{}"),
        f"lag(ts, 3) {W}",
        f"lead(ts, 2) {W}",
    )
)
def seq_multivariate(spark, sf_dir):
    samples = frames.multivariate(hourly(spark, sf_dir), ["low", "high", "close"], 4, 3)
    return frames.flatten(samples, 4, 3, ["low", "high"])


def _shifts_sql(shifts) -> str:
    names = []
    for by in shifts:
        for name in ("close", "volume"):
            label = f"{name}_lead{by}" if by > 0 else f"{name}_lag{-by}" if by < 0 else name
            names.append(f"lead({name}, {by}) {W} AS {label}")
    return ", ".join(names)


@query(_complete(_shifts_sql([-2, -1, 0, 1]), f"lag(ts, 2) {W}", f"lead(ts, 1) {W}"))
def supervised_full(spark, sf_dir):
    return frames.supervised_full(hourly(spark, sf_dir), ["close", "volume"], 2, 2)


@query(_complete(_shifts_sql([-2, -1, 0, 3]), f"lag(ts, 2) {W}", f"lead(ts, 3) {W}"))
def supervised_single(spark, sf_dir):
    return frames.supervised_single(hourly(spark, sf_dir), ["close", "volume"], 2, 3)


# Streams ----------------------------------------------------------------------------------------


def _events_topic(spark, sf_dir, name: str) -> DataFrame:
    """Hourly candles as a stream of events: each twice, and malformed ones among them."""
    events = with_malformed(encoded(hourly(spark, sf_dir)))
    topic = topic_of(spark, name, events.unionByName(events))
    return ev.stream_events(spark, topic, "parquet", maxFilesPerTrigger="2")


KEYS = ("Timestamp", "Symbol")


@query(WIRE_SQL)
def stream_dedup(spark, sf_dir):
    parsed = streams.parse_stream(_events_topic(spark, sf_dir, "dedup"), KEYS, ranges.RANGE_SCHEMA)
    table = new_table(spark, "deduped")
    streams.append_stream(parsed, table, table, trigger=None).awaitTermination()
    return plain(tables.read_table(spark, table).select(*WIRE))


@query(f"SELECT symbol, ts AS timestamp, {SINGLE} FROM ({CH}) UNION ALL SELECT symbol, ts AS timestamp, {SINGLE} FROM ({CH})")
def stream_append_table(spark, sf_dir):
    good, _ = records.split_rejects(_events_topic(spark, sf_dir, "appended"), ranges.RANGE_SCHEMA)
    table = new_table(spark, "streamed")
    streams.append_stream(good, table, table, trigger=None).awaitTermination()
    return plain(tables.read_table(spark, table).select(*WIRE))


@query(
    f"""
    SELECT symbol, timestamp, low, high, open, close, volume FROM ({WIRE_SQL})
    UNION ALL
    SELECT symbol || '-OLD', timestamp, -1, high, open, close, volume FROM ({WIRE_SQL}) WHERE timestamp < '2024-01-11'"""
)
def stream_upsert(spark, sf_dir):
    table = new_table(spark, "upserted", grain="day")
    # Rows of before: some are corrected by the stream, those under another name stay.
    old = wire(hourly(spark, sf_dir)).where(F.col("Timestamp") < "2024-01-11").withColumn("Low", F.lit(-1).cast("float"))
    tables.append(old.unionByName(old.withColumn("Symbol", F.concat("Symbol", F.lit("-OLD")))), table)
    parsed = streams.parse_stream(_events_topic(spark, sf_dir, "merged"), KEYS, ranges.RANGE_SCHEMA)
    streams.upsert_stream(parsed, table, table, KEYS, trigger=None).awaitTermination()
    return plain(tables.read_table(spark, table).select(*WIRE))


@query(WIRE_SQL)
def stream_dedup_late(spark, sf_dir):
    """Candles in two batches, the earlier half last: late rows with new keys are kept, copies are not."""
    candles = wire(hourly(spark, sf_dir))
    late = F.col("Timestamp") < "2024-01-15"
    topic = scratch_path(spark, "late")
    table = new_table(spark, "late", grain="day")
    checkpoint = scratch_path(spark, "late-checkpoint")
    for part in (candles.where(~late), candles):
        ev.write_events(records.encode_events(part, fields=WIRE), topic, "parquet")
        parsed = streams.parse_stream(ev.stream_events(spark, topic, "parquet"), KEYS, ranges.RANGE_SCHEMA, distinct=False)
        streams.upsert_stream(parsed, table, table, KEYS, checkpoint, trigger=None, update=False).awaitTermination()
    return plain(tables.read_table(spark, table).select(*WIRE))


@query(f"SELECT symbol, timestamp, low, high, open, close, volume + 1 AS volume FROM ({WIRE_SQL})")
def stream_upsert_last(spark, sf_dir):
    """Each candle is sent, and then corrected twice: in the same batch, and in a later one."""
    candles = wire(hourly(spark, sf_dir))
    topic = scratch_path(spark, "corrected")
    table = new_table(spark, "corrected", grain="day")
    checkpoint = scratch_path(spark, "corrected-checkpoint")
    more = candles.withColumn("Volume", F.col("Volume") + 1)
    off = candles.withColumn("Volume", F.col("Volume") + 7)
    for part in (candles.unionByName(off), more):
        ev.write_events(records.encode_events(part, fields=WIRE), topic, "parquet")
        parsed = streams.parse_stream(ev.stream_events(spark, topic, "parquet"), KEYS, ranges.RANGE_SCHEMA, distinct=False)
        streams.upsert_stream(parsed, table, table, KEYS, checkpoint, trigger=None, arrival="Volume").awaitTermination()
    return plain(tables.read_table(spark, table).select(*WIRE))


ARRIVED = "event_id * 2 + CASE WHEN user_id % 5 = 0 THEN 101 ELSE 0 END"


@query(
    f"""
    SELECT symbol, ts, value, arrival FROM (
        SELECT event_type AS symbol, ts, value, {ARRIVED} AS arrival, max(ts) OVER (
            PARTITION BY event_type ORDER BY {ARRIVED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
        FROM events)
    WHERE m IS NULL OR ts > m"""
)
def stream_monotonic(spark, sf_dir):
    """Ticks in two runs of one stream, every fifth user's some fifty ticks late."""
    rows = ticks(spark, sf_dir).select("symbol", "ts", "value", F.expr(ARRIVED).alias("arrival"))
    half = rows.agg((F.max("arrival") / 2).alias("half")).scalar()
    topic = scratch_path(spark, "arrivals")
    table, checkpoint = scratch_path(spark, "increasing"), scratch_path(spark, "increasing-checkpoint")
    for part in (rows.where(F.col("arrival") <= half), rows.where(F.col("arrival") > half)):
        part.write.mode("append").parquet(topic)
        arriving = spark.readStream.schema(rows.schema).parquet(topic)
        kept = monotonic.monotonic_stream(arriving, "ts", "arrival", ["symbol"])
        writer = kept.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(table)


@query(f"SELECT symbol, ts, {', '.join(PRICES)} FROM ({CM})")
def stream_candles(spark, sf_dir):
    """Minute candles of ticks that arrive in an order of their own, a third at a time."""
    rows = ticks(spark, sf_dir).select("symbol", "ts", "value", "event_id")
    topic, checkpoint = scratch_path(spark, "ticks"), scratch_path(spark, "candles-checkpoint")
    table = f"wick_live_{uuid.uuid4().hex[:12]}"
    live_candles.candle_table(spark, table, live_candles.partial_candles(rows, order=["event_id"]).schema, location=scratch_path(spark, "live"))
    for part in range(3):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).write.mode("append").parquet(topic)
        arriving = spark.readStream.schema(rows.schema).parquet(topic)
        live_candles.candle_stream(arriving, table, table, order=["event_id"], checkpoint=checkpoint, trigger=None).awaitTermination()
    return live_candles.read_candles(spark, table)


def _fan_out(spark, sf_dir, name: str) -> tuple[dict[str, str], str]:
    """A topic per symbol, malformed events among them, sent to a table each by one stream in two
    runs. Returns the tables and the folder of progress rows."""
    root, checkpoint, path = (scratch_path(spark, f"{name}-{what}") for what in ("topics", "checkpoint", "progress"))
    body = F.from_json(F.col("value").cast("string"), "Symbol string, Timestamp string")
    events = encoded(hourly(spark, sf_dir)).withColumns({"topic": body["Symbol"], "late": body["Timestamp"] >= "2024-01-15"})
    events = events.unionByName(events.withColumn("value", F.lit("not json").cast("binary")))
    symbols = [row[0] for row in ticks(spark, sf_dir).select("symbol").distinct().collect()]
    targets = {symbol: new_table(spark, f"{name}_{symbol}", grain="month") for symbol in sorted(symbols)}
    stream = f"{name}-{uuid.uuid4().hex[:8]}"
    listener = fanout.ProgressTable(spark, path, stream, list(targets))
    spark.streams.addListener(listener)
    try:
        for late in (True, False):
            fanout.write_topics(events.where(F.col("late") == late).drop("late"), root)
            arriving = fanout.stream_topics(spark, list(targets), "parquet", root=root)
            schema = ranges.RANGE_SCHEMA
            fanout.fanout_stream(arriving, targets, stream, schema, checkpoint=checkpoint, trigger=None).awaitTermination()
            listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    return targets, path


@query(WIRE_SQL)
def stream_fanout(spark, sf_dir):
    tables_of, _ = _fan_out(spark, sf_dir, "fanout")
    parts = [tables.read_table(spark, table).where(F.col("Symbol") == symbol).select(*WIRE) for symbol, table in tables_of.items()]
    return plain(reduce(DataFrame.unionByName, parts))


@query(
    f"""
    SELECT symbol AS topic, CAST(2 AS BIGINT) AS batches, count(*) AS rows, count(*) AS rejects, max(timestamp) AS latest
    FROM ({WIRE_SQL}) GROUP BY 1"""
)
def stream_progress(spark, sf_dir):
    _, path = _fan_out(spark, sf_dir, "progress")
    return plain(fanout.progress(spark, path).drop("stream"))
