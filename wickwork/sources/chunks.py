"""Time ranges cut into chunks short enough for one request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickwork.functions.frequency import floor_div, from_micros, to_micros
from wickwork.schema import MAX_CHUNK_HOURS

HOUR = 3_600_000_000


def check_hours(hours: int) -> int:
    if not 0 < hours <= MAX_CHUNK_HOURS:
        raise ValueError(f"a chunk is {MAX_CHUNK_HOURS} hours or less, and more than none: {hours}")
    return hours


def range_chunks(ranges: DataFrame, start: str = "start", end: str = "end", hours: int = MAX_CHUNK_HOURS) -> DataFrame:
    """Each range as consecutive chunks of ``hours``, the last one cut off at the end.

    Other columns are repeated. A range which does not start before its end has no chunks.
    """
    width = check_hours(hours) * HOUR
    kind = ranges.schema[start].dataType
    low, high = to_micros(F.col(start)), to_micros(F.col(end))
    numbered = ranges.where(low < high).withColumn(
        "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), floor_div(high - low - 1, width)))
    )
    chunk = low + F.col("_n") * F.lit(width)
    return numbered.withColumns(
        {
            start: from_micros(chunk, kind),
            end: from_micros(F.least(chunk + F.lit(width), high), kind),
        }
    ).drop("_n")
