"""The candle record, its wire forms and the fixed values around it."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names, order and types of a candle on the wire and in tables.
CANDLE_SCHEMA = T.StructType(
    [
        T.StructField("Timestamp", T.TimestampType(), True),
        T.StructField("Low", T.FloatType(), True),
        T.StructField("High", T.FloatType(), True),
        T.StructField("Open", T.FloatType(), True),
        T.StructField("Close", T.FloatType(), True),
        T.StructField("Volume", T.FloatType(), True),
    ]
)
CANDLE_COLUMNS = CANDLE_SCHEMA.fieldNames()

# Text form of a timestamp (Spark pattern), first marks, chunk width limit,
# rows per flushed file, freshness buffer, quote currency, trigger.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
DEFAULT_MARK = "2014-01-01 00:00:00"
ENTITY_MARKS = {"btc": "2015-07-20 21:37:00", "eth": "2016-05-18 00:14:00"}
MAX_CHUNK_HOURS = 5
FLUSH_ROWS = 100_000
BUFFER_SECONDS = 60
GRANULARITY_SECONDS = 60
QUOTE = "USD"
TRIGGER = "20 seconds"

# Key/value form of an event, as a message broker delivers it.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), True),
    ]
)
