"""Record functions: wire forms to candles and back, text forms, constants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickwork.schema import CANDLE_COLUMNS, CANDLE_SCHEMA, QUOTE, TIMESTAMP_FORMAT


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def timestamp_to_text(ts: Column, fmt: str = TIMESTAMP_FORMAT) -> Column:
    return F.date_format(ts, fmt)


def text_to_timestamp(text: Column, fmt: str | None = TIMESTAMP_FORMAT) -> Column:
    """Text to timestamp; null where it is none. Without a format any ISO-like text will do."""
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def symbol_of_entity(entity: Column) -> Column:
    return F.upper(F.concat(entity, F.lit(f"-{QUOTE}")))


def bytes_to_text(value: Column) -> Column:
    """UTF-8 text; invalid bytes are replaced rather than failing the query."""
    return value.cast("string")


def array_to_candle(values: Column, schema: T.StructType = CANDLE_SCHEMA) -> Column:
    """``[epoch seconds, low, high, open, close, volume]`` as a record, by place.

    A shorter array leaves the fields behind its end null, a longer one loses its end.
    """
    fields = []
    for place, field in enumerate(schema):
        value = F.get(values, F.lit(place))
        if isinstance(field.dataType, T.TimestampType):
            value = epoch_to_timestamp(value)
        fields.append(value.cast(field.dataType).alias(field.name))
    return F.struct(*fields)


def enrich(df: DataFrame, symbol: str, ts: str = "Timestamp") -> DataFrame:
    """Add the symbol and the year (as text) of every row."""
    return df.withColumn("Symbol", F.lit(symbol)).withColumn("Year", F.date_format(ts, "yyyy").cast("string"))


def in_declared_order(df: DataFrame, schema: T.StructType = CANDLE_SCHEMA) -> DataFrame:
    return df.select(*schema.fieldNames())


def parse_events(events: DataFrame, schema: T.StructType = CANDLE_SCHEMA, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events with a JSON ``value`` to records; what does not parse has null fields."""
    parsed = events.select(*keep, F.from_json(bytes_to_text(F.col("value")), schema).alias("data"))
    return parsed.select(*keep, "data.*")


def split_rejects(
    events: DataFrame, schema: T.StructType = CANDLE_SCHEMA, key: str | Sequence[str] = "Timestamp"
) -> tuple[DataFrame, DataFrame]:
    """Parsed records with all their key fields, and the raw events of which one is missing or does not parse."""
    parsed = events.withColumn("_data", F.from_json(bytes_to_text(F.col("value")), schema))
    keys = [key] if isinstance(key, str) else list(key)
    missing = reduce(or_, [F.col(f"_data.{name}").isNull() for name in keys])
    rejects = parsed.where(missing).select(*events.columns)
    return parsed.where(~missing).select("_data.*"), rejects


def encode_events(df: DataFrame, ts: str = "Timestamp", fields: list[str] | None = None) -> DataFrame:
    """Records to events: key is the time as text, value the record as JSON, both UTF-8 bytes."""
    fields = fields or CANDLE_COLUMNS
    options = {"timestampFormat": TIMESTAMP_FORMAT, "timestampNTZFormat": TIMESTAMP_FORMAT, "ignoreNullFields": "false"}
    key = timestamp_to_text(F.col(ts)).cast("binary").alias("key")
    return df.select(key, F.to_json(F.struct(*fields), options).cast("binary").alias("value"))
