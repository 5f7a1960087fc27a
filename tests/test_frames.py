"""The framings against plain loops, with series cut into blocks of all sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickwork.operators import frames

pytestmark = pytest.mark.usefixtures("interpreted")

N, L, H = 17, 4, 3
COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def series(spark):
    df = spark.range(2 * N).select(
        F.when(F.col("id") < N, "p").otherwise("q").alias("symbol"),
        F.timestamp_seconds(F.lit(1_700_000_040) + F.pmod("id", F.lit(N)) * 60).alias("ts"),
        (F.col("id") * 1.0).alias("a"),
        (F.col("id") * 10.0).alias("b"),
        (F.col("id") * 100.0).alias("c"),
    )
    return df.repartition(3).cache()


def matrix(symbol: str) -> np.ndarray:
    ids = np.arange(N) + (0 if symbol == "p" else N)
    return np.stack([ids * 1.0, ids * 10.0, ids * 100.0], axis=1)


def check(samples, model):
    """``model`` gives the (x, y) pairs of one series' matrix, in order."""
    found = samples.orderBy("symbol", "ts").collect()
    expected = [pair for symbol in "pq" for pair in model(matrix(symbol))]
    assert len(found) == len(expected)
    for row, (x, y) in zip(found, expected):
        assert np.array_equal(np.array(row["x"]), x)
        assert np.array_equal(np.array(row["y"]), y)


OPTIONS = [
    {},
    {"block": "2min", "block_rows": 4},
    {"block": "5min", "block_rows": 5},
    {"gap_free": "min", "block_rows": 6},
    {"gap_free": "min"},
]


@pytest.mark.parametrize("options", OPTIONS)
def test_samples(series, options):
    def univariate(m):
        return [(m[i - L : i, 0], m[i : i + H, 0]) for i in range(L, N - H + 1)]

    def classification(m):
        return [(m[i : i + L, :2], m[i + L - 1, 2]) for i in range(N - L)]

    def forecast(m):
        return [(m[i : i + L], m[i + L : i + L + H, -1]) for i in range(N - L - H + 1)]

    def multivariate(m):
        return [(m[i : i + L, :-1], m[i + L - 1 : i + L + H - 1, -1]) for i in range(N - L - H + 2)]

    check(frames.univariate(series, "a", L, H, **options), univariate)
    check(frames.classification(series, ["a", "b"], "c", L, **options), classification)
    check(frames.forecast(series, COLUMNS, L, H, **options), forecast)
    check(frames.multivariate(series, COLUMNS, L, H, **options), multivariate)


def test_target_by_place_or_name(series):
    by_place = frames.forecast(series, COLUMNS, L, H, target=0)
    by_name = frames.forecast(series, COLUMNS, L, H, target="a")
    assert by_place.exceptAll(by_name).isEmpty()
    assert by_place.first()["y"] == [float(v) for v in by_name.first()["y"]]


@pytest.mark.parametrize("options", OPTIONS)
def test_supervised(series, options):
    full = frames.supervised_full(series, COLUMNS, 2, 3, **options)
    assert full.count() == 2 * (N - 2 - 2)
    row = full.orderBy("symbol", "ts").first()
    assert [row[name] for name in ("a_lag2", "a_lag1", "a", "a_lead1", "a_lead2")] == [0, 1, 2, 3, 4]
    single = frames.supervised_single(series, COLUMNS, 2, 3, **options)
    assert single.count() == 2 * (N - 2 - 3)
    assert single.columns[2:] == [f"{c}{s}" for s in ("_lag2", "_lag1", "", "_lead3") for c in COLUMNS]
    assert frames.supervised_single(series, COLUMNS, 2, 3, dropnan=False, **options).count() == 2 * N


def test_parenthesized_names(series):
    full = frames.supervised_full(series, ["a", "b"], 1, 2, parenthesized=True)
    assert full.columns[2:] == ["var1(t-1)", "var2(t-1)", "var1(t)", "var2(t)", "var1(t+1)", "var2(t+1)"]
    single = frames.supervised_single(series, ["a"], 1, 3, parenthesized=True)
    assert single.columns[2:] == ["a(t-1)", "a(t)", "a(t+3)"]


def test_nulls_stay_in_samples_and_drop_rows(series):
    df = series.withColumn("a", F.when(F.col("a") != 5, F.col("a")))
    xs = [row["x"] for row in frames.univariate(df, "a", L, H).where("symbol = 'p'").orderBy("ts").collect()]
    assert len(xs) == N - L - H + 1
    assert xs[2] == [2, 3, 4, None]
    assert frames.supervised_full(df, ["a"], 1, 1).where("symbol = 'p'").count() == N - 1 - 2


def test_lag_lead(series):
    rows = frames.lag_lead(series, ["a"], [1], [2], block="2min", block_rows=2).where("symbol = 'q'").orderBy("ts").collect()
    assert [row["a_lag1"] for row in rows] == [None, *range(N, 2 * N - 1)]
    assert [row["a_lead2"] for row in rows] == [*range(N + 2, 2 * N), None, None]


def test_series_without_keys_and_by_number(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("v")).repartition(4)
    samples = frames.univariate(df, "v", 3, 2, ts="id", keys=(), block=7, block_rows=5)
    rows = samples.orderBy("id").collect()
    assert [(row["id"], row["x"], row["y"]) for row in rows] == [
        (i, [i - 3.0, i - 2.0, i - 1.0], [float(i), i + 1.0]) for i in range(3, 99)
    ]


def test_sparse_blocks(spark):
    """Rows far apart: many blocks have one row or none, and windows reach over several."""
    df = spark.range(30).select((F.col("id") * F.col("id") * 50).alias("id"), F.col("id").cast("double").alias("v"))
    rows = frames.univariate(df, "v", 5, 4, ts="id", keys=(), block=10, block_rows=5).orderBy("id").collect()
    assert [row["y"][0] for row in rows] == [float(i) for i in range(5, 27)]


def test_flatten(series):
    flat = frames.flatten(frames.forecast(series, ["a", "b"], 2, 1, target="b"), 2, 1, ["a", "b"])
    assert flat.columns == ["symbol", "ts", "x_1_a", "x_1_b", "x_2_a", "x_2_b", "y_1"]


@pytest.mark.parametrize("minutes", [[0, 1, 3, 4, 5], [0, 1, 1, 2, 3]])
def test_gap_free_is_looked_at(spark, minutes):
    rows = spark.createDataFrame([("a", float(i), f"2024-01-01 00:0{m}") for i, m in enumerate(minutes)], "symbol string, close double, t string")
    rows = rows.select("symbol", "close", F.col("t").cast("timestamp").alias("ts"))
    with pytest.raises(Exception, match="not gap-free"):
        frames.univariate(rows, "close", 2, 1, gap_free="min").collect()
    assert frames.univariate(rows, "close", 2, 1).count() == 3
