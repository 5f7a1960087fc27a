"""Supervised framing: lags, leads and sliding windows of a series as rows.

All framings share one plan. Rows are numbered within their series, cut into blocks by number,
and each block gets a copy of the few rows it needs from its neighbours. Row frames of a window
over the block then give the samples; a task sorts and holds a block, not a series.

Numbering takes a shuffle of its own, with blocks of time ``block``. A series without gaps (as the
fills return it) has its numbers in its timestamps: name its frequency as ``gap_free`` and only
one shuffle is left; a missing or repeated row then fails the query.

``N`` rows, look-back ``L`` and horizon ``H`` give these samples per series:

===========================  ============  =====================================================
:func:`univariate`           N-L-H+1       L values, then the H values after them
:func:`classification`       N-L           L rows, target of the last of them; the very last
                                           full window is left out
:func:`forecast`             N-L-H+1       L rows of all features, H values of the target
:func:`multivariate`         N-L-H+2       L rows without the last column, H values of it,
                                           beginning in the last input row
:func:`supervised_full`      N-n_in-n_out+1  all lags, the row, leads up to n_out-1
:func:`supervised_single`    N-n_in-n_out  all lags, the row, one lead
===========================  ============  =====================================================
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickwork.functions.frequency import DAY, Frequency, floor_div, to_micros
from wickwork.plans.blocks import ANY, BLOCK, BLOCK_ROWS, EDGE, TIMES, row_numbers, with_halo

Keys = Sequence[str]


def order_value(df: DataFrame, order: str) -> Column:
    """The ordering column as ``bigint``: whole numbers as they are, times in microseconds."""
    if isinstance(df.schema[order].dataType, T.IntegralType):
        return F.col(order).cast("bigint")
    return to_micros(F.col(order))


def block_width(df: DataFrame, order: str, block: str | int | None) -> int:
    """Width of a block in units of :func:`order_value`."""
    if isinstance(df.schema[order].dataType, T.IntegralType):
        return int(block or BLOCK_ROWS)
    return Frequency.of(block or "D").nominal_micros


def order_limits(df: DataFrame, order: str) -> tuple[int, int]:
    """What :func:`order_value` can be."""
    return ANY if isinstance(df.schema[order].dataType, T.IntegralType) else TIMES


def _numbered(df: DataFrame, keys: Keys, ts: str, gap_free, block) -> DataFrame:
    rows = df.withColumn("_t", order_value(df, ts)).where(F.col("_t").isNotNull())
    if gap_free is None:
        return row_numbers(rows, keys, "_t", block_width(df, ts, block), limits=order_limits(df, ts)).drop("_t")
    freq = Frequency.of(gap_free)
    if freq.kind == "fixed":
        # Neighbours differ by one, which is all that counts; the first number may be any.
        return rows.withColumn("_row", floor_div(F.col("_t"), freq.nominal_micros)).drop("_t")
    if freq.count != 1:
        raise ValueError("a gap-free calendar frequency must have count 1")
    time_of_day = F.pmod(F.col("_t"), F.lit(DAY))
    return rows.withColumn("_row", freq.ordinal(F.col("_t"), time_of_day)).drop("_t")


def _haloed(
    df: DataFrame,
    columns: Sequence[str],
    keys: Keys,
    ts: str,
    behind: int,
    ahead: int,
    gap_free: str | None,
    block: str | int | None,
    block_rows: int,
) -> tuple[DataFrame, WindowSpec]:
    """The rows in blocks with their halo, and the window over a block."""
    keys = list(keys)
    wanted = [name for name in dict.fromkeys([ts, *columns]) if name not in keys]
    rows = _numbered(df.select(*keys, *wanted), keys, ts, gap_free, block)
    rows = with_halo(rows, "_row", behind, ahead, max(block_rows, behind, ahead, 1))
    w = Window.partitionBy(*keys, BLOCK).orderBy("_row")
    if gap_free is not None:
        # The promise is looked at where it is relied on: neighbours in a block are one step apart.
        step = F.col("_row") - F.lag("_row").over(w)
        broken = F.concat(F.lit("not gap-free: a missing or second row before "), F.col(ts).cast("string"))
        holds = F.when(F.coalesce(F.col("_step"), F.lit(1)) == 1, F.lit(True)).otherwise(F.raise_error(broken).cast("boolean"))
        rows = rows.withColumn("_step", step).where(holds).drop("_step")
    return rows, w


def _own(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(EDGE) == 0)


def _rows(names: Sequence[str], frame: WindowSpec) -> Column:
    """The rows of the frame, each an array of columns, nulls included (which ``collect_list``
    would leave out of bare values)."""
    return F.collect_list(F.array(*names)).over(frame)


def _framed(
    rows: DataFrame, keys: Keys, ts: str, x: Column, lookback: int, y: Column, horizon: int, flat_x: bool = False
) -> DataFrame:
    """Samples with all their rows; ``y``, and ``x`` if asked for, as plain values."""
    framed = _own(rows.select(*keys, ts, EDGE, x.alias("x"), y.alias("y")))
    framed = framed.where((F.size("x") == lookback) & (F.size("y") == horizon))
    return framed.select(*keys, ts, (F.flatten("x") if flat_x else F.col("x")).alias("x"), F.flatten("y").alias("y"))


def univariate(
    df: DataFrame,
    value: str,
    lookback: int,
    horizon: int,
    ts: str = "ts",
    keys: Keys = ("symbol",),
    *,
    gap_free: str | None = None,
    block: str | int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``x``: the previous values, ``y``: the values from the row named by ``ts`` onwards."""
    rows, w = _haloed(df, [value], keys, ts, lookback, horizon - 1, gap_free, block, block_rows)
    x, y = _rows([value], w.rowsBetween(-lookback, -1)), _rows([value], w.rowsBetween(0, horizon - 1))
    return _framed(rows, keys, ts, x, lookback, y, horizon, flat_x=True)


def classification(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    length: int,
    ts: str = "ts",
    keys: Keys = ("symbol",),
    *,
    gap_free: str | None = None,
    block: str | int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``x``: rows of features, ``y``: the target in the last of them, which ``ts`` names."""
    rows, w = _haloed(df, [*features, target], keys, ts, length - 1, 1, gap_free, block, block_rows)
    x = _rows(features, w.rowsBetween(-(length - 1), 0))
    followed = F.lead(F.lit(True)).over(w)
    framed = _own(rows.select(*keys, ts, EDGE, x.alias("x"), F.col(target).alias("y"), followed.alias("_followed")))
    return framed.where((F.size("x") == length) & F.col("_followed")).drop(EDGE, "_followed")


def forecast(
    df: DataFrame,
    features: Sequence[str],
    lookback: int,
    horizon: int,
    target: str | int = -1,
    ts: str = "ts",
    keys: Keys = ("symbol",),
    *,
    gap_free: str | None = None,
    block: str | int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``x``: previous rows of all features, ``y``: the target (a name or a place among the
    features) from the row named by ``ts`` onwards."""
    target = features[target] if isinstance(target, int) else target
    rows, w = _haloed(df, [*features, target], keys, ts, lookback, horizon - 1, gap_free, block, block_rows)
    x, y = _rows(features, w.rowsBetween(-lookback, -1)), _rows([target], w.rowsBetween(0, horizon - 1))
    return _framed(rows, keys, ts, x, lookback, y, horizon)


def multivariate(
    df: DataFrame,
    columns: Sequence[str],
    steps_in: int,
    steps_out: int,
    ts: str = "ts",
    keys: Keys = ("symbol",),
    *,
    gap_free: str | None = None,
    block: str | int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``x``: rows of all columns but the last, ``y``: values of the last column, beginning in the
    last input row, which ``ts`` names."""
    rows, w = _haloed(df, columns, keys, ts, steps_in - 1, steps_out - 1, gap_free, block, block_rows)
    x = _rows(columns[:-1], w.rowsBetween(-(steps_in - 1), 0))
    y = _rows([columns[-1]], w.rowsBetween(0, steps_out - 1))
    return _framed(rows, keys, ts, x, steps_in, y, steps_out)


def flatten(samples: DataFrame, lookback: int, horizon: int, features: Sequence[str] = ()) -> DataFrame:
    """Sample arrays as scalar columns: ``x_1``.. or ``x_1_close``.., and ``y_1``.. or ``y``."""
    rest = [name for name in samples.columns if name not in ("x", "y")]
    flat = []
    for step in range(lookback):
        row = F.get("x", F.lit(step))
        if features:
            flat += [F.get(row, F.lit(i)).alias(f"x_{step + 1}_{name}") for i, name in enumerate(features)]
        else:
            flat.append(row.alias(f"x_{step + 1}"))
    if isinstance(samples.schema["y"].dataType, T.ArrayType):
        flat += [F.get("y", F.lit(step)).alias(f"y_{step + 1}") for step in range(horizon)]
    else:
        flat.append(F.col("y"))
    return samples.select(*rest, *flat)


def _shifted(name: str, by: int, w: WindowSpec) -> Column:
    """A column of the row ``by`` places ahead, null beyond the series."""
    return F.lead(name, by).over(w) if by > 0 else F.lag(name, -by).over(w) if by < 0 else F.col(name)


def lag_lead(
    df: DataFrame,
    columns: Sequence[str],
    lags: Sequence[int] = (),
    leads: Sequence[int] = (),
    ts: str = "ts",
    keys: Keys = ("symbol",),
    *,
    gap_free: str | None = None,
    block: str | int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every column of the rows so many places before and after, beside the row itself."""
    rows, w = _haloed(df, columns, keys, ts, max(lags, default=0), max(leads, default=0), gap_free, block, block_rows)
    out = [F.col(name) for name in (ts, *columns)]
    out += [_shifted(name, -by, w).alias(f"{name}_lag{by}") for by in lags for name in columns]
    out += [_shifted(name, by, w).alias(f"{name}_lead{by}") for by in leads for name in columns]
    return _own(rows.select(*keys, EDGE, *out)).drop(EDGE)


def _label(name: str, by: int, parenthesized: bool) -> str:
    if parenthesized:
        return f"{name}(t{by:+d})" if by else f"{name}(t)"
    return f"{name}_lead{by}" if by > 0 else f"{name}_lag{-by}" if by < 0 else name


def _supervised(df, columns, shifts, ts, keys, dropnan, parenthesized, labels, options) -> DataFrame:
    rows, w = _haloed(df, columns, keys, ts, max(0, -min(shifts)), max(0, max(shifts)), *options)
    out = [
        _shifted(name, by, w).alias(_label(label, by, parenthesized))
        for by in shifts
        for name, label in zip(columns, labels)
    ]
    framed = _own(rows.select(*keys, ts, EDGE, *out)).drop(EDGE)
    if dropnan:
        quoted = [f"`{_label(label, by, parenthesized)}`" for by in shifts for label in labels]
        framed = framed.dropna(how="any", subset=quoted)
    return framed


def supervised_full(
    df: DataFrame,
    columns: Sequence[str],
    n_in: int = 1,
    n_out: int = 1,
    dropnan: bool = True,
    ts: str = "ts",
    keys: Keys = ("symbol",),
    *,
    parenthesized: bool = False,
    gap_free: str | None = None,
    block: str | int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Lags ``n_in``..1, the row, and leads up to ``n_out``-1. With ``parenthesized`` the columns
    are called ``var1(t-1)``, ``var1(t)``, ``var1(t+1)``, by place."""
    labels = [f"var{i + 1}" for i in range(len(columns))] if parenthesized else list(columns)
    shifts = list(range(-n_in, n_out))
    options = (gap_free, block, block_rows)
    return _supervised(df, columns, shifts, ts, keys, dropnan, parenthesized, labels, options)


def supervised_single(
    df: DataFrame,
    columns: Sequence[str],
    n_in: int = 1,
    n_out: int = 1,
    dropnan: bool = True,
    ts: str = "ts",
    keys: Keys = ("symbol",),
    *,
    parenthesized: bool = False,
    gap_free: str | None = None,
    block: str | int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Lags ``n_in``..1, the row, and the one lead ``n_out`` of every column. With
    ``parenthesized`` the columns are called ``close(t-1)``, ``close(t)``, ``close(t+3)``."""
    shifts = [*range(-n_in, 1), n_out]
    options = (gap_free, block, block_rows)
    return _supervised(df, columns, shifts, ts, keys, dropnan, parenthesized, list(columns), options)
