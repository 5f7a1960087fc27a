import random

import pytest
from pyspark.sql import functions as F

from wickwork.operators.candles import monotonic_filter
from wickwork.streaming import monotonic

SCHEMA = "Symbol string, Timestamp int, arrival int, note double"


def plain(batches, first_pass=False):
    """What passes, arrival by arrival."""
    top, out = {}, []
    for batch in batches:
        known = dict(top)
        for symbol, ts, arrival, note in sorted(batch, key=lambda r: (r[2], r[1]) if r[2] is not None and r[1] is not None else (0, 0)):
            if ts is None or arrival is None:
                continue
            if (first_pass and symbol not in known) or symbol not in top or ts > top[symbol]:
                out.append((symbol, ts, arrival, note))
            top[symbol] = max(ts, top.get(symbol, ts))
    return sorted(out, key=repr)


def stream(spark, tmp_path, batches, first_pass=False):
    """Each batch in a run of its own: the state is read back from the checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).repartition(3).write.mode("append").parquet(source)
        kept = monotonic.monotonic_stream(spark.readStream.schema(SCHEMA).parquet(source), first_pass=first_pass)
        writer = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r) for r in spark.read.schema(SCHEMA).parquet(out).collect()), key=repr)


CASE = [
    [("a", 5, 1, 0.5), ("a", 3, 2, None), ("a", 6, 3, 1.0), ("a", 6, 4, 2.0), ("a", 9, 5, 3.0), ("b", 1, 1, None), (None, 2, 9, 1.0)],
    [("a", 7, 6, 0.0), ("a", 10, 7, 0.0), ("c", 4, 1, 0.0), ("c", 2, 2, 0.0), (None, 1, 10, 1.0), ("b", None, 2, 0.0), ("b", 5, None, 0.0)],
    [("a", 10, 8, 0.0), ("a", 11, 9, 0.0), ("b", 2, 3, 0.0), ("c", 4, 3, 0.0), (None, 3, 11, 1.0)],
]


@pytest.mark.parametrize("first_pass", [False, True])
def test_state_lasts_over_restarts(spark, tmp_path, first_pass):
    got = stream(spark, tmp_path, CASE, first_pass)
    assert got == plain(CASE, first_pass)
    if not first_pass:
        assert [r[1] for r in sorted(got, key=lambda r: r[2]) if r[0] == "a"] == [5, 6, 9, 10, 11]


def test_random_batches_and_small_hold(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), i + rng.randint(-30, 30), i, float(i)) for i in range(600)]
    batches = [rows[:250], rows[250:]]
    assert stream(spark, tmp_path, batches) == plain(batches)


def test_rows_ruled_out_are_let_go(monkeypatch):
    monkeypatch.setattr(monotonic, "HELD", 4)
    processor = monotonic.IncreasingFilter(False)

    class Top:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    processor.top = Top()
    rng = random.Random(1)
    from pyspark.sql import Row

    rows = [Row(k="a", ts=t, _a=a, _t=t) for a, t in enumerate(rng.choices(range(100), k=300))]
    shuffled = rng.sample(rows, len(rows))
    got = [r.ts for r in processor.handleInputRows(("a",), iter(shuffled), None)]
    want, top = [], -1
    for row in rows:
        if row._t > top:
            want.append(row._t)
            top = row._t
    assert got == want and processor.top.value == (top,)
    assert list(processor.handleInputRows(("a",), iter(rows), None)) == []


def test_first_pass_of_a_batch(spark):
    rows = spark.createDataFrame([r for r in CASE[0] if r[0]], SCHEMA)
    every = monotonic_filter(rows, "Timestamp", "arrival", ["Symbol"], first_pass=True)
    assert every.count() == 6
    mark = F.when(F.col("Symbol") == "a", F.lit(5))
    some = monotonic_filter(rows, "Timestamp", "arrival", ["Symbol"], mark=mark, first_pass=True)
    assert sorted((r[0], r[1]) for r in some.collect()) == [("a", 6), ("a", 9), ("b", 1)]
