"""Series cut into blocks, so that no series has to fit in one task.

A window over ``partitionBy(symbol)`` puts a whole series into one task. One symbol may hold a
third of all rows, so every ordered operator here runs over ``partitionBy(symbol, block)``, where
a block is a fixed stretch of the ordering column. Order values are unique within a series, hence
a block has at most width / resolution rows, whatever the size of the series.

What a block needs to know of the others comes with it as additional rows, which are dropped
after the window:

* reach without limit (last value seen, running maximum, next value): every block gets an *edge*
  row before its first and, if asked for, after its last row. They hold what has to be carried
  over, taken from one pre-aggregated summary row per block (:func:`with_edges`);
* reach of a fixed number of rows (lags, leads, sliding windows): rows near the border of a block
  are copied into the neighbour (:func:`with_halo`), blocks being cut by row number
  (:func:`row_numbers`).

Rows are shuffled once, by (keys, block): the summaries are made from the same exchange as the rows
they describe, so the source is read and computed once. Summaries in turn form a tree. ``FAN``
neighbouring blocks have one summary of their own, and so on until one group covers all values that
there can be; each level is carried to the one below it (:func:`_scanned`). So no window has more
than ``FAN`` summaries, whatever the length of a series. Ten thousand years of days, or of stretches
of 8192 minutes, are one level; whole numbers in blocks of 8192 are two. All steps are deterministic functions
of the data; a lost executor can recompute any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.functions.frequency import floor_div

BLOCK_ROWS = 8192
#: Summaries that have one summary on the next level, and that one task may have in a window.
FAN = 1 << 22
EDGE = "_edge"
BLOCK = "_block"

#: What order columns hold as a rule: whole numbers, and microseconds of the years 1 to 9999. Others
#: are as right, but all of a series' blocks beyond a limit meet in one group.
ANY = (-(1 << 53), 1 << 53)
TIMES = (-62_135_596_800_000_000, 253_402_300_800_000_000)

_BEFORE = (Window.unboundedPreceding, -1)
#: How a value of earlier (``next``: later) blocks is combined: within a group, and along a window.
_COMBINED = {"max": F.max, "min": F.min, "sum": F.sum}


def _placed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows shuffled into a stated number of partitions: plans that share them, and unions of such,
    need no further exchange."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _scanned(rows: DataFrame, keys: Sequence[str], number: str, span: int, values: dict[str, str]) -> DataFrame:
    """Add ``_of_<value>`` for each value: the combination of all rows before (``next``: behind) a row.

    ``number`` orders the rows of a series, unique and from 0 up to less than ``span``; what is beyond that
    falls into the first and last group. ``values`` says how columns are combined: ``last`` and ``next``
    take the nearest one that is not null.
    """
    up, top = f"{number}u", F.lit((span - 1) // FAN)
    rows = rows.withColumn(up, F.least(F.greatest(floor_div(F.col(number), FAN), F.lit(0).cast("bigint")), top))
    columns, by = rows.columns, [*keys, up]
    rows = rows.withColumn("_side", F.lit(0))
    if span > FAN:
        rows = _placed(rows, by)
        combined = []
        for name, how in values.items():
            if how in _COMBINED:
                combined.append(_COMBINED[how](name).alias(name))
            else:
                nearest = F.max_by if how == "last" else F.min_by
                combined.append(nearest(name, F.when(F.col(name).isNotNull(), F.col(number))).alias(name))
        parents = _scanned(rows.groupBy(*by).agg(*combined), keys, up, span // FAN + 1, values)
        # One row before the group's own and, if anything comes from behind, one after them.
        types = {field.name: field.dataType for field in rows.schema}
        sides = [-1, 1] if "next" in values.values() else [-1]
        carried = []
        for side in sides:
            fields = [F.lit(side).alias("_side")]
            for name, how in values.items():
                here = (how == "next") == (side == 1)
                fields.append((F.col(f"_of_{name}") if here else F.lit(None)).cast(types[name]).alias(name))
            carried.append(F.struct(*fields))
        around = parents.select(*by, F.array(*carried).alias("_around")).select(*by, F.inline("_around"))
        rows = rows.unionByName(_placed(around, by), allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy("_side", number).rowsBetween(*_BEFORE)
    after = Window.partitionBy(*by).orderBy(F.desc("_side"), F.desc(number)).rowsBetween(*_BEFORE)
    for name, how in values.items():
        if how in _COMBINED:
            found = _COMBINED[how](name).over(before)
        else:
            found = F.last(name, ignorenulls=True).over(before if how == "last" else after)
        rows = rows.withColumn(f"_of_{name}", found)
    return rows.where("_side = 0").select(*columns, *[f"_of_{name}" for name in values]).drop(up)


def with_edges(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    width: int,
    carried: Sequence[str] = (),
    *,
    maxima: Sequence[str] = (),
    counted: str | None = None,
    anchor: str | None = None,
    ahead: bool = False,
    limits: tuple[int, int] = ANY,
) -> DataFrame:
    """Add the block number and the edge rows of every block.

    ``order`` is a ``bigint`` without nulls, as a rule within ``limits``. The leading edge (``_edge`` = -1) has the order value
    of the last row before the block, the last non-null value of each ``carried`` column, and the
    largest value of each of ``maxima`` so far. The trailing edge (``_edge`` = 1, with ``ahead``)
    has the order value of the next row and the next non-null values. ``counted`` names a new
    column for the number of earlier rows, ``anchor`` one for the smallest order value of the
    series; both are set on leading edges only, and null elsewhere.
    """
    keys = list(keys)
    rows = _placed(rows.withColumn(BLOCK, floor_div(F.col(order), width)), [*keys, BLOCK])
    at = F.col(order)
    types = {field.name: field.dataType for field in rows.schema}
    kept = [name for name in rows.columns if name not in (*keys, BLOCK)]
    extra = [name for name in (counted, anchor) if name]

    aggregates = [F.max(order).alias("_last"), F.min(order).alias("_first"), F.count(F.lit(1)).alias("_rows")]
    # A look at every column: the summaries then read what the rows' own branch reads, and Spark runs
    # one exchange for both.
    aggregates.append(F.max(F.xxhash64(*kept)).alias("_seen"))
    for name in carried:
        known = F.when(F.col(name).isNotNull(), at)
        aggregates.append(F.max_by(name, known).alias(f"_last_{name}"))
        if ahead:
            aggregates.append(F.min_by(name, known).alias(f"_first_{name}"))
    aggregates += [F.max(name).alias(f"_max_{name}") for name in maxima]
    summary = rows.groupBy(*keys, BLOCK).agg(*aggregates).where("_seen is not null").drop("_seen")

    values = {"_last": "last"}
    values |= {f"_last_{name}": "last" for name in carried}
    values |= {f"_max_{name}": "max" for name in maxima}
    if counted:
        values["_rows"] = "sum"
    if anchor:
        values["_min"] = "min"
        summary = summary.withColumn("_min", F.col("_first"))
    if ahead:
        values["_first"] = "next"
        values |= {f"_first_{name}": "next" for name in carried}
    # Blocks are counted from the first one there can be.
    low, high = limits[0] // width, limits[1] // width
    numbered = summary.withColumn("_n", F.col(BLOCK) - F.lit(low))
    summary = _scanned(numbered, keys, "_n", high - low + 1, values)

    def edge(side: int, found: dict[str, Column]) -> Column:
        fields = [F.lit(side).alias(EDGE)]
        for name in (*kept, *extra):
            fields.append(found.get(name, F.lit(None)).cast(types.get(name, "bigint")).alias(name))
        return F.struct(*fields)

    leading = {order: F.col("_of__last")}
    leading |= {name: F.col(f"_of__last_{name}") for name in carried}
    leading |= {name: F.col(f"_of__max_{name}") for name in maxima}
    if counted:
        leading[counted] = F.coalesce("_of__rows", F.lit(0))
    if anchor:
        leading[anchor] = F.coalesce("_of__min", "_min")
    edges = [edge(-1, leading)]
    if ahead:
        trailing = {order: F.col("_of__first")}
        trailing |= {name: F.col(f"_of__first_{name}") for name in carried}
        edges.append(edge(1, trailing))
    edge_rows = summary.select(*keys, BLOCK, F.array(*edges).alias("_edges"))
    edge_rows = edge_rows.select(*keys, BLOCK, F.inline("_edges"))

    plain = rows.select(
        *keys, BLOCK, F.lit(0).alias(EDGE), *kept, *[F.lit(None).cast("bigint").alias(name) for name in extra]
    )
    return plain.unionByName(_placed(edge_rows, [*keys, BLOCK]))


def forward(keys: Sequence[str], order: str) -> Window:
    """Rows of a block in order, its leading edge first."""
    return Window.partitionBy(*keys, BLOCK).orderBy(EDGE, order)


def backward(keys: Sequence[str], order: str) -> Window:
    """Rows of a block in reverse, its trailing edge first."""
    return Window.partitionBy(*keys, BLOCK).orderBy(F.desc(EDGE), F.desc(order))


def drop_edges(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(EDGE) == 0).drop(EDGE, BLOCK)


def row_numbers(
    rows: DataFrame, keys: Sequence[str], order: str, width: int, name: str = "_row", limits: tuple[int, int] = ANY
) -> DataFrame:
    """Number the rows of each series from 0, in order, without a whole series in one task."""
    w = forward(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    edged = with_edges(rows, keys, order, width, counted="_before", limits=limits)
    # The leading edge is the first row of its block, so the count of rows so far includes it.
    number = F.max("_before").over(w) + F.sum(F.lit(1)).over(w) - 2
    return drop_edges(edged.withColumn(name, number.cast("bigint"))).drop("_before")


def with_halo(rows: DataFrame, number: str, behind: int, ahead: int, block_rows: int) -> DataFrame:
    """Cut by row number, and copy rows into each neighbour block that looks back or ahead at them.

    A block sees ``behind`` rows before and ``ahead`` rows after it. ``_edge`` is 0 for the rows
    which belong to the block, and not 0 for copies.
    """
    if max(behind, ahead) > block_rows:
        raise ValueError("a block must be at least as long as the reach of the window")
    own = floor_div(F.col(number), block_rows)
    offset = F.pmod(F.col(number), F.lit(block_rows))
    after, before = offset >= block_rows - behind, offset < ahead
    sides = (
        F.when(after & before, F.array(F.lit(0), F.lit(1), F.lit(-1)))
        .when(after, F.array(F.lit(0), F.lit(1)))
        .when(before, F.array(F.lit(0), F.lit(-1)))
        .otherwise(F.array(F.lit(0)))
    )
    return rows.withColumn(EDGE, F.explode(sides)).withColumn(BLOCK, own + F.col(EDGE))
