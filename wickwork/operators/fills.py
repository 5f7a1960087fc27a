"""Calendar spines and the gap fills.

All fills share one plan. A row knows the time of the row before it, so it knows which grid
points are missing in between; it is exploded into these points and itself. No calendar table is
built, shuffled or joined: one shuffle brings the rows of a block together, and only missing
points are added. Values for the gaps are found before the explode, on the rows there are.

Three fills, which differ in what a gap and an existing null get:

============================  ==============================  =================================
:func:`fill_forward`          last non-null value             leading nulls stay
:func:`fill_backward`         next non-null, else the last    other columns are null in gaps
:func:`fill_rows`             the next row as it is, its      every column
                              nulls then filled forward
============================  ==============================  =================================

``regular=True`` states what holds for a candle table: one row per series and time, every time
on the grid; a row for which it does not hold fails the query. Without it the series is first brought into that form by an aggregation with
map-side combine (so neither a burst of rows nor copies of one time can fill a task), and the
full rows are joined back where they are part of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickwork.functions.frequency import Frequency, floor_div, from_micros, to_micros
from wickwork.plans.blocks import BLOCK_ROWS, TIMES, backward, drop_edges, forward, with_edges
from wickwork.plans.joins import null_safe_join

# Grid points made from one array; keeps the arrays of long gaps small.
_RUN = 4096


def _spread(rows: DataFrame, low: Column, high: Column, name: str, shuffle_by: Sequence[str] | None = None) -> DataFrame:
    """One row per whole number in ``low``..``high``, in runs of at most ``_RUN``."""
    runs = rows.withColumn("_low", low).withColumn("_high", high).where(F.col("_low") <= F.col("_high"))
    last_run = floor_div(F.col("_high") - F.col("_low"), _RUN)
    runs = runs.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), last_run)))
    if shuffle_by is not None:
        # A stated number, as AQE would join these few rows into one task before they grow.
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        runs = runs.repartition(tasks, *shuffle_by, "_run")
    start = F.col("_low") + F.col("_run") * _RUN
    stop = F.least(start + (_RUN - 1), F.col("_high"))
    return runs.withColumn(name, F.explode(F.sequence(start, stop))).drop("_low", "_high", "_run")


def series_bounds(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """First and last time of every series."""
    return df.groupBy(*keys).agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def date_spine(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ("symbol",), freq: str | Frequency = "D") -> DataFrame:
    """Every grid point from the first to the last time of a series, counted from the first.

    The points of a long series are made by many tasks: its runs are shuffled before they are
    expanded.
    """
    freq, kind = Frequency.of(freq), df.schema[ts].dataType
    bounds = df.groupBy(*keys).agg(F.min(to_micros(F.col(ts))).alias("_min"), F.max(to_micros(F.col(ts))).alias("_max"))
    bounds = bounds.where(F.col("_min").isNotNull())
    points = _spread(bounds, F.lit(0).cast("bigint"), freq.ordinal(F.col("_max"), F.col("_min")), "_i", shuffle_by=keys)
    return points.select(*keys, from_micros(freq.point(F.col("_i"), F.col("_min")), kind).alias(ts))


def _anchored(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the first time of the series. No hint: AQE broadcasts the firsts if they turn out small,
    and splits a hot series in a sort-merge join if not."""
    first = rows.groupBy(*keys).agg(F.min("_t").alias("_min"))
    return null_safe_join(rows, first, keys) if keys else rows.withColumn("_min", first.scalar())


def _aligned(kind: T.DataType, freq: Frequency) -> bool:
    """Whether no time of that type can be off the grid."""
    return isinstance(kind, T.DateType) and freq == Frequency.of("D")


def _on_grid(rows: DataFrame, keys: Sequence[str], freq: Frequency, kind: T.DataType) -> DataFrame:
    """Add the grid point at or before each row, and whether the row is on it."""
    if _aligned(kind, freq):
        return rows.withColumn("_point", F.col("_t")).withColumn("_real", F.lit(True))
    rows = _anchored(rows, keys)
    point = freq.point(freq.ordinal(F.col("_t"), F.col("_min")), F.col("_min"))
    return rows.withColumn("_point", point).withColumn("_real", F.col("_point") == F.col("_t")).drop("_min")


def _grid_slots(rows: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """One row per series and grid point which rows are on, or after and before the next: the
    last one ends the grid. ``_real`` says whether a row is on it."""
    slots = rows.groupBy(*keys, "_point").agg(F.max("_real").alias("_real"), *aggregates)
    return slots.withColumnRenamed("_point", "_t")


def _timed(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("_t", to_micros(F.col(ts))).where(F.col("_t").isNotNull())


def _with_gaps(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    kind: T.DataType,
    freq: Frequency,
    in_gap: dict[str, Column],
    columns: Sequence[str],
    regular: bool = False,
) -> DataFrame:
    """Explode each row into the missing points before it and itself.

    Rows have ``_t``, ``_prev`` (time of the row before, null for the first) and ``_anchor``. With
    ``regular`` a row off the grid, or a second one of its time, is an error rather than moved.
    """
    at = freq.ordinal(F.col("_t"), F.col("_anchor"))
    if regular:
        holds = (freq.point(at, F.col("_anchor")) == F.col("_t")) & (F.col("_prev").isNull() | (F.col("_prev") < F.col("_t")))
        broken = F.concat(F.lit("not regular: a row off the grid or a second one at "), from_micros(F.col("_t"), kind).cast("string"))
        at = F.when(holds, at).otherwise(F.raise_error(broken).cast("bigint"))
    rows = rows.withColumn("_at", at)
    since = F.coalesce(freq.ordinal(F.col("_prev"), F.col("_anchor")) + 1, F.col("_at"))
    # A copy of the same time has nothing to add but itself.
    points = _spread(rows, F.least(since, F.col("_at")), F.col("_at"), "_i")
    here = F.col("_i") == F.col("_at")
    out = []
    for name in columns:
        if name in keys:
            out.append(F.col(name))
        elif name == ts:
            out.append(from_micros(freq.point(F.col("_i"), F.col("_anchor")), kind).alias(ts))
        else:
            out.append(F.when(here, F.col(name)).otherwise(in_gap.get(name, F.lit(None))).alias(name))
    return points.select(*out, here.alias("_here"))


def _with_previous(
    rows: DataFrame,
    keys: Sequence[str],
    freq: Frequency,
    carried: Sequence[str],
    block_rows: int,
    ahead: bool = False,
    **before: str,
) -> DataFrame:
    """Rows with their edges, the time of the row before (``_prev``), the start of the series
    (``_anchor``), and for ``new=column`` the column's last non-null value before the row."""
    edged = with_edges(rows, keys, "_t", freq.nominal_micros * block_rows, carried, anchor="_anchor", ahead=ahead, limits=TIMES)
    # One frame for all of them, hence one pass.
    earlier = forward(keys, "_t").rowsBetween(Window.unboundedPreceding, -1)
    found = {name: F.last(column, ignorenulls=True).over(earlier) for name, column in before.items()}
    return edged.withColumns(
        {"_prev": F.last("_t").over(earlier), "_anchor": F.first("_anchor").over(earlier)} | found
    )


def _fill_column(df, value, ts, keys, freq, regular, block_rows, back: bool) -> DataFrame:
    freq, kind, columns, keys = Frequency.of(freq), df.schema[ts].dataType, df.columns, list(keys)
    rows = _timed(df, ts)
    slots, names = rows, columns
    aligned = _aligned(kind, freq)
    if not regular:
        # Among copies of a time with different values the largest one counts.
        of_slot = F.max(F.when(F.col("_real"), F.col(value))).alias(value)
        slots = _grid_slots(_on_grid(rows, keys, freq, kind), keys, of_slot)
        slots = slots.withColumn(ts, from_micros(F.col("_t"), kind))
        names = [*keys, ts, value, "_real"]

    # Carrying all columns of the slots lets both uses of them share one computation.
    carried = [value] if regular else [value, "_real"]
    filled = _with_previous(slots, keys, freq, carried, block_rows, ahead=back, _before=value)
    gap_value = F.col("_before")
    if back:
        later = backward(keys, "_t").rowsBetween(Window.unboundedPreceding, -1)
        filled = filled.withColumn("_next", F.coalesce(value, F.last(value, ignorenulls=True).over(later)))
        gap_value = F.coalesce("_next", "_before")
    filled = filled.withColumn("_gap", gap_value).withColumn(value, F.coalesce(value, "_gap"))
    filled = drop_edges(filled)
    points = _with_gaps(filled, keys, ts, kind, freq, {value: F.col("_gap")}, names, regular)
    if regular:
        return points.drop("_here")

    # Rows look their value up in an inner join, of which AQE can split either side, and which
    # leaves out what is off the grid. If nothing is, rows with a value pass without it.
    real = F.col("_here") & F.coalesce("_real", F.lit(False))
    known = points.where(real).select(*keys, to_micros(F.col(ts)).alias("_t"), F.col(value).alias("_filled"))
    empty = F.col(value).isNull()
    looked_up = null_safe_join(rows.where(empty) if aligned else rows, known, [*keys, "_t"])
    full = looked_up.withColumn(value, F.coalesce(value, "_filled")).select(*columns)
    if aligned:
        full = full.unionByName(rows.where(~empty).select(*columns))
    return full.unionByName(points.where(~real).drop("_here", "_real"), allowMissingColumns=True)


def fill_forward(
    df: DataFrame,
    value: str = "y",
    ts: str = "ds",
    keys: Sequence[str] = ("symbol",),
    freq: str | Frequency = "D",
    *,
    to_day: bool = False,
    regular: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Complete the calendar and fill one column with its last non-null value.

    ``to_day`` cuts times to dates first. Nulls before the first value stay; other columns are
    null in gaps; rows off the grid are lost. Rows sharing a time see that time's own value.
    """
    if to_day:
        df = df.withColumn(ts, F.to_date(ts))
    return _fill_column(df, value, ts, keys, freq, regular, block_rows, back=False)


def fill_backward(
    df: DataFrame,
    value: str = "y",
    ts: str = "ds",
    keys: Sequence[str] = ("symbol",),
    freq: str | Frequency = "D",
    *,
    regular: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Complete the calendar and fill one column with its next non-null value, the tail forward.

    Nulls that were there already are filled as well; other columns are null in gaps.
    """
    return _fill_column(df, value, ts, keys, freq, regular, block_rows, back=True)


def _first_rows(df: DataFrame, ts: str, keys: Sequence[str], freq: Frequency) -> DataFrame:
    """For each grid point, the first row from it to the next point: one row per point."""
    rest = [name for name in df.columns if name not in (*keys, ts)]
    # All see the same rows in the same order, so they choose the same row, even among copies.
    first = [F.min_by(name, "_t").alias(name) for name in rest]
    return _grid_slots(_on_grid(_timed(df, ts), keys, freq, df.schema[ts].dataType), keys, *first).drop("_real")


def _next_rows(df, ts, keys, freq, regular, block_rows, then_forward: bool) -> DataFrame:
    freq, kind, columns, keys = Frequency.of(freq), df.schema[ts].dataType, df.columns, list(keys)
    slots = _timed(df, ts) if regular else _first_rows(df, ts, keys, freq).withColumn(ts, from_micros(F.col("_t"), kind))
    rest = [name for name in columns if name not in (*keys, ts)]
    if then_forward:
        before = {f"_before_{name}": name for name in rest}
        filled = _with_previous(slots, keys, freq, rest, block_rows, **before)
        filled = filled.withColumns({name: F.coalesce(name, f"_before_{name}") for name in rest})
    else:
        filled = _with_previous(slots, keys, freq, [] if regular else rest, block_rows)
    return _with_gaps(
        drop_edges(filled), keys, ts, kind, freq, {name: F.col(name) for name in rest}, columns, regular
    ).drop("_here")


def asof_next(
    df: DataFrame,
    ts: str = "ds",
    keys: Sequence[str] = ("symbol",),
    freq: str | Frequency = "D",
    *,
    regular: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each grid point with the whole first row at or after it, nulls included."""
    return _next_rows(df, ts, keys, freq, regular, block_rows, then_forward=False)


def fill_rows(
    df: DataFrame,
    ts: str = "ds",
    keys: Sequence[str] = ("symbol",),
    freq: str | Frequency = "D",
    *,
    regular: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """As :func:`asof_next`, then every column's remaining nulls filled forward."""
    return _next_rows(df, ts, keys, freq, regular, block_rows, then_forward=True)


def spine_left_join(
    df: DataFrame,
    ts: str = "ds",
    keys: Sequence[str] = ("symbol",),
    freq: str | Frequency = "D",
    *,
    regular: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The calendar with the rows that fall on it: off-grid rows are lost, copies all stay.

    The rows are not shuffled as a whole. They pass through a filter, and the calendar points
    without a row are found from the distinct times alone and added.
    """
    freq, kind, columns, keys = Frequency.of(freq), df.schema[ts].dataType, df.columns, list(keys)
    rows = _timed(df, ts)
    if regular:
        times = rows.select(*keys, "_t", F.lit(True).alias("_real"))
    else:
        rows = _on_grid(rows, keys, freq, kind)
        times = _grid_slots(rows, keys)
        rows = rows.where("_real")
    filled = _with_previous(times, keys, freq, [] if regular else ["_real"], block_rows)
    points = _with_gaps(drop_edges(filled), keys, ts, kind, freq, {}, [*keys, ts, "_real"], regular)
    gaps = points.where(~(F.col("_here") & F.coalesce("_real", F.lit(False)))).select(*keys, ts)
    return rows.select(*columns).unionByName(gaps, allowMissingColumns=True)
