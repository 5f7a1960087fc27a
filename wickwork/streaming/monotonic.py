"""The increasing filter over a stream: one running maximum per series, kept in the state store.

A broker keeps order within a partition only, and one task reads a partition, so the rows of a series
that arrive in one batch meet in one task here as well. That task holds at most some twice the rows it is
going to pass: rows that another one rules out are let go on the way. Bound a batch by ``maxOffsetsPerTrigger`` (or ``maxFilesPerTrigger``) where a long history is read first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructType

from wickwork.operators.frames import order_value
from wickwork.session import ship_package
from wickwork.streaming.queries import use_rocksdb

#: Rows taken in before those that are ruled out are let go.
HELD = 10_000


def increasing(rows: list[tuple[int, int, Row]]) -> list[tuple[int, int, Row]]:
    """Rows ``(arrival, time, row)`` whose time exceeds that of all which arrived before, in order of arrival.

    Two rows of one arrival are taken with the earlier time first."""
    kept, top = [], None
    for row in sorted(rows, key=lambda row: row[:2]):
        if top is None or row[1] > top:
            kept.append(row)
            top = row[1]
    return kept


class IncreasingFilter(StatefulProcessor):
    """Holds the largest time seen of each series."""

    def __init__(self, first_pass: bool):
        self.first_pass = first_pass

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", StructType().add("t", LongType()))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = self.top.get()
        top = latest = seen[0] if seen else None
        open_pass = self.first_pass and top is None
        held: list[tuple[int, int, Row]] = []
        limit = HELD
        for row in rows:
            latest = row._t if latest is None else max(latest, row._t)
            if open_pass:
                yield Row(**{name: row[name] for name in self.columns(row)})
            elif top is None or row._t > top:
                held.append((row._a, row._t, row))
                if len(held) >= limit:
                    held = increasing(held)
                    limit = max(HELD, 2 * len(held))
        for _, _, row in increasing(held):
            yield Row(**{name: row[name] for name in self.columns(row)})
        self.top.update((latest,))

    @staticmethod
    def columns(row: Row) -> list[str]:
        return [name for name in row.__fields__ if name not in ("_a", "_t")]

    def close(self) -> None:
        pass


def monotonic_stream(
    df: DataFrame,
    ts: str = "Timestamp",
    arrival: str = "arrival",
    keys: Sequence[str] = ("Symbol",),
    first_pass: bool = False,
) -> DataFrame:
    """Rows whose time exceeds that of every row of their series which arrived before them, in this
    batch or an earlier one, also after a restart.

    ``arrival`` orders the rows of a batch, as a broker's offset does; it is unique within a series.
    A row without a time or an arrival is left out; null is a key like others. With ``first_pass``
    the first batch that holds rows of a series passes unfiltered, and sets the mark. The state is one
    number per series, on disk (RocksDB).
    """
    use_rocksdb(df.sparkSession)
    ship_package(df.sparkSession)
    rows = df.withColumns({"_a": order_value(df, arrival), "_t": order_value(df, ts)})
    rows = rows.where(F.col("_a").isNotNull() & F.col("_t").isNotNull())
    return rows.groupBy(*keys).transformWithState(IncreasingFilter(first_pass), df.schema, "Append", "None")
