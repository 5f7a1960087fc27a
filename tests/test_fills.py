"""The three fills by hand, and against pandas on random series cut into blocks of all sizes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wickwork.operators import candles, fills

pytestmark = pytest.mark.usefixtures("interpreted")

HAND = [("2024-01-01", 1.0), ("2024-01-02", None), ("2024-01-05", 5.0), ("2024-01-06", None), ("2024-01-08", None)]


@pytest.fixture(scope="module")
def hand(spark):
    df = spark.createDataFrame(HAND, "ds string, y double")
    return df.select(F.lit("a").alias("symbol"), F.to_timestamp("ds").alias("ds"), "y", (F.col("y") * 2).alias("z")).cache()


def values(df, column="y"):
    return [row[column] for row in df.orderBy("ds").collect()]


@pytest.mark.parametrize("regular", [True, False])
@pytest.mark.parametrize("block_rows", [2, 8192])
def test_hand_case(hand, regular, block_rows):
    options = {"regular": regular, "block_rows": block_rows}
    assert values(fills.fill_forward(hand, **options)) == [1, 1, 1, 1, 5, 5, 5, 5]
    assert values(fills.fill_backward(hand, **options)) == [1, 5, 5, 5, 5, 5, 5, 5]
    assert values(fills.fill_rows(hand, **options)) == [1, 1, 5, 5, 5, 5, 5, 5]
    assert values(fills.asof_next(hand, **options)) == [1, None, 5, 5, 5, None, None, None]
    assert values(fills.spine_left_join(hand, **options)) == [1, None, None, None, 5, None, None, None]


def test_other_columns_are_null_in_gaps(hand):
    for fill in (fills.fill_forward, fills.fill_backward):
        assert values(fill(hand), "z") == [2, None, None, None, 10, None, None, None]
    assert values(fills.fill_rows(hand), "z") == [2, 2, 10, 10, 10, 10, 10, 10]


def test_next_row_off_the_grid(spark):
    rows = [("2024-01-01 00:00:00", 1.0), ("2024-01-02 12:00:00", 7.0), ("2024-01-04 06:00:00", 9.0)]
    df = spark.createDataFrame(rows, "ds string, y double").select(F.lit("a").alias("symbol"), F.to_timestamp("ds").alias("ds"), "y")
    found = fills.asof_next(df, block_rows=2).orderBy("ds").collect()
    assert [(str(row.ds), row.y) for row in found] == [
        ("2024-01-01 00:00:00", 1.0),
        ("2024-01-02 00:00:00", 7.0),
        ("2024-01-03 00:00:00", 9.0),
        ("2024-01-04 00:00:00", 9.0),
    ]


def test_one_series_without_keys(hand):
    for regular in (True, False):
        df = hand.drop("symbol")
        assert values(fills.fill_forward(df, keys=(), regular=regular, block_rows=2)) == [1, 1, 1, 1, 5, 5, 5, 5]
        assert values(fills.fill_rows(df, keys=(), regular=regular)) == [1, 1, 5, 5, 5, 5, 5, 5]
        assert values(fills.spine_left_join(df, keys=(), regular=regular)) == [1, None, None, None, 5, None, None, None]


def test_types_stay(spark, hand):
    for kind in ("date", "timestamp", "timestamp_ntz"):
        df = hand.withColumn("ds", F.col("ds").cast(kind))
        assert dict(fills.fill_forward(df).dtypes)["ds"] == kind
    assert dict(fills.fill_forward(hand, to_day=True).dtypes)["ds"] == "date"


def test_copies_of_a_day_stay(spark):
    rows = [("2024-01-01 09:00:00", 1.0, 1), ("2024-01-01 17:00:00", None, 2), ("2024-01-03 10:00:00", None, 3)]
    df = spark.createDataFrame(rows, "ds string, y double, n int").withColumn("symbol", F.lit("a")).withColumn("ds", F.to_timestamp("ds"))
    found = fills.fill_forward(df, to_day=True).orderBy("ds", "n").collect()
    assert [(str(row.ds), row.y, row.n) for row in found] == [
        ("2024-01-01", 1.0, 1),
        ("2024-01-01", 1.0, 2),
        ("2024-01-02", 1.0, None),
        ("2024-01-03", 1.0, 3),
    ]


def test_null_times_are_left_out(spark, hand):
    df = hand.unionByName(spark.sql("SELECT 'a' AS symbol, CAST(NULL AS TIMESTAMP) AS ds, 3.0D AS y, 6.0D AS z"))
    for regular in (True, False):
        assert values(fills.fill_forward(df, regular=regular)) == [1, 1, 1, 1, 5, 5, 5, 5]


def random_series(seed: int, off_grid: bool) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for case in range(25):
        n = int(rng.integers(1, 40))
        hours = np.sort(rng.choice(120, size=n, replace=False))
        ds = pd.Timestamp("2024-02-27") + pd.to_timedelta(hours, unit="h")
        if off_grid:
            ds = ds + pd.to_timedelta(np.where(np.arange(n) > 0, rng.integers(0, 50, n), 0), unit="min")
        part = pd.DataFrame({"symbol": f"s{case}", "ds": ds})
        for name in ("y", "z"):
            value = rng.integers(0, 1000, n).astype(float)
            part[name] = np.where(rng.random(n) < 0.4, np.nan, value)
        parts.append(part)
    return pd.concat(parts, ignore_index=True)


def grid(part):
    return pd.date_range(part["ds"].min(), part["ds"].max(), freq="h", name="ds")


def by_row(part):
    return part.set_index("ds").reindex(grid(part), method="backfill").ffill()


def by_join(part):
    return pd.DataFrame(index=grid(part)).join(part.set_index("ds"))


def forward_model(part):
    joined = by_join(part)
    return joined.assign(y=joined["y"].ffill())


def backward_model(part):
    joined = by_join(part)
    return joined.assign(y=joined["y"].bfill().ffill())


MODELS = {
    "fill_forward": forward_model,
    "fill_backward": backward_model,
    "fill_rows": by_row,
    "asof_next": lambda part: part.set_index("ds").reindex(grid(part), method="backfill"),
    "spine_left_join": by_join,
}


@pytest.mark.parametrize("fill", sorted(MODELS))
@pytest.mark.parametrize("off_grid", [False, True])
@pytest.mark.parametrize("block_rows", [5])
def test_fill_equals_pandas(spark, fill, off_grid, block_rows):
    data = random_series(block_rows + off_grid, off_grid)
    df = spark.createDataFrame(data).select("symbol", "ds", *[F.nanvl(name, F.lit(None)).alias(name) for name in "yz"])
    expected = pd.concat(
        [MODELS[fill](part.drop(columns="symbol")).assign(symbol=symbol).reset_index() for symbol, part in data.groupby("symbol")]
    )
    expected = expected.sort_values(["symbol", "ds"])[["symbol", "ds", "y", "z"]].reset_index(drop=True)
    for regular in [False] if off_grid else [False, True]:
        found = getattr(fills, fill)(df, freq="h", regular=regular, block_rows=block_rows).toPandas()
        found = found.sort_values(["symbol", "ds"])[["symbol", "ds", "y", "z"]].reset_index(drop=True)
        pd.testing.assert_frame_equal(found, expected, check_dtype=False)


@pytest.mark.parametrize("regular", [True, False])
def test_null_series_key_is_a_series(spark, regular):
    rows = [(None, "2024-01-01", 1.0), (None, "2024-01-03", 3.0), ("a", "2024-01-01", 5.0)]
    df = spark.createDataFrame(rows, "symbol string, ds string, y double").withColumn("ds", F.to_timestamp("ds"))
    for fill in (fills.fill_forward, fills.fill_backward):
        assert fill(df, regular=regular).where("symbol is null").count() == 3
    assert fills.spine_left_join(df, regular=regular).where("symbol is null").count() == 3


def test_open_and_close_of_equal_times(spark):
    rows = [("a", 0, 1.0, 2), ("a", 0, 2.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, s long, value double, trade long").withColumn("ts", F.timestamp_seconds("s"))
    one = candles.ohlcv_candles(df, order=["trade"]).first()
    assert (one.open, one.close) == (2.0, 1.0)


@pytest.mark.parametrize("fill", [fills.fill_forward, fills.fill_backward])
@pytest.mark.parametrize("times", [["2024-01-01 00:00", "2024-01-02 12:00"], ["2024-01-01 00:00", "2024-01-03 00:00", "2024-01-03 00:00"]])
def test_regular_is_looked_at(spark, fill, times):
    rows = spark.createDataFrame([("a", float(i), t) for i, t in enumerate(times)], "symbol string, y double, t string")
    rows = rows.select("symbol", "y", F.col("t").cast("timestamp").alias("ds"))
    with pytest.raises(Exception, match="not regular"):
        fill(rows, regular=True).collect()
    with pytest.raises(Exception, match="not regular"):
        fills.asof_next(rows, regular=True).collect()
    with pytest.raises(Exception, match="not regular"):
        fills.spine_left_join(rows, regular=True).collect()
    assert fill(rows).count() >= 2
