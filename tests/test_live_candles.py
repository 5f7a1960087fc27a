import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wickwork.operators.candles import ohlcv_candles
from wickwork.sources.tables import read_table
from wickwork.streaming import live_candles as lc

pytestmark = pytest.mark.usefixtures("interpreted")

SCHEMA = "symbol string, ts timestamp, value double, number long, size double"
START = datetime(2024, 1, 1, 23, 55)


def made(n, seed=1):
    """Ticks over midnight, several of one time, in order of their number."""
    rng = random.Random(seed)
    return [(rng.choice("ab"), START + timedelta(seconds=rng.randint(0, 600)), float(rng.randint(1, 50)), i, float(rng.randint(1, 9))) for i in range(n)]


@pytest.fixture()
def live(spark, name, location, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    volume = F.sum("size")

    def partial(rows):
        return lc.partial_candles(spark.createDataFrame(rows, SCHEMA), volume=volume, order=["number"])

    lc.candle_table(spark, name, lc.partial_candles(empty, volume=volume, order=["number"]).schema, location=location)
    return name, partial


def expected(spark, rows):
    candles = ohlcv_candles(spark.createDataFrame(rows, SCHEMA), volume=F.sum("size"), order=["number"])
    return sorted(tuple(r) for r in candles.select("symbol", "ts", *lc.CANDLE).collect())


def got(spark, table):
    return sorted(tuple(r) for r in lc.read_candles(spark, table).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order(spark, live, seed):
    table, partial = live
    rows = made(400, seed)
    arriving = random.Random(seed).sample(rows, len(rows))
    for batch in range(4):
        lc.merge_batch(partial(arriving[batch * 100 : (batch + 1) * 100]), table, "s", batch)
    assert got(spark, table) == expected(spark, rows)


def test_a_batch_counts_once(spark, live):
    """Repeated whole, or after only some of its candles were written."""
    table, partial = live
    rows = made(200)
    first, second = partial(rows[:120]), partial(rows[120:])
    lc.merge_batch(first, table, "s", 0)
    lc.merge_batch(first, table, "s", 0)
    assert got(spark, table) == expected(spark, rows[:120])
    lc.merge_batch(second.where("symbol = 'a'"), table, "s", 1)
    lc.merge_batch(second, table, "s", 1)
    lc.merge_batch(second, table, "s", 1)
    assert got(spark, table) == expected(spark, rows)
    # Another stream's batch of the same number is another batch.
    lc.merge_batch(second, table, "t", 1)
    assert got(spark, table) == expected(spark, rows + rows[120:])


def test_late_ticks_correct_and_others_stay(spark, live):
    table, partial = live
    at = START
    lc.merge_batch(partial([("a", at + timedelta(seconds=30), 5.0, 2, 1.0), ("b", at, 7.0, 1, 1.0)]), table, "s", 0)
    files = {r[0] for r in read_table(spark, table).where("symbol = 'b'").select(F.input_file_name()).collect()}
    lc.merge_batch(partial([("a", at + timedelta(days=40), 1.0, 9, 1.0)]), table, "s", 1)
    assert {r[0] for r in read_table(spark, table).where("symbol = 'b'").select(F.input_file_name()).collect()} == files
    lc.merge_batch(partial([("a", at + timedelta(seconds=10), 9.0, 1, 2.0), (None, at, 1.0, 3, 1.0), ("a", None, 1.0, 4, 1.0), ("a", at, None, 5, 1.0)]), table, "s", 2)
    rows = {(r["symbol"], r["ts"]): tuple(r[c] for c in lc.CANDLE) for r in lc.read_candles(spark, table).collect()}
    assert rows[("a", START)] == (5.0, 9.0, 9.0, 5.0, 3.0)
    assert rows[("b", START)] == (7.0, 7.0, 7.0, 7.0, 1.0)
    assert len(rows) == 3


def test_empty_batch(spark, live):
    table, partial = live
    lc.merge_batch(partial([]), table, "s", 0)
    assert got(spark, table) == []


def test_stream_restarts(spark, live, tmp_path):
    table, _ = live
    rows = made(300)
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    for part in (rows[200:], rows[:100], rows[100:200]):
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        lc.candle_stream(stream, table, table, volume=F.sum("size"), order=["number"], checkpoint=checkpoint, trigger=None).awaitTermination()
    assert got(spark, table) == expected(spark, rows)
