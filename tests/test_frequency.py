import pandas as pd
import pytest
from pyspark.sql import functions as F

from wickwork.functions.frequency import Frequency
from wickwork.operators.fills import date_spine

pytestmark = pytest.mark.usefixtures("interpreted")

ALIASES = [
    "D", "3D", "h", "4h", "min", "15min", "90s", "W", "2W", "W-WED", "MS", "2MS", "ME", "3ME", "QS", "QE", "YS", "2YS", "YE", "B", "3B",
]
RANGES = [
    ("2023-12-30 05:07:00", "2024-03-02 04:00:00"),
    ("2024-01-01 00:00:00", "2024-03-31 00:00:00"),
    ("1969-11-30 00:00:00", "1970-02-01 00:00:00"),
    ("2024-01-31 23:59:59", "2024-01-31 23:59:59"),
]


@pytest.mark.parametrize("alias", ALIASES)
def test_spine_equals_pandas(spark, alias):
    rows = [(i, at) for i, bounds in enumerate(RANGES) for at in bounds]
    df = spark.createDataFrame(rows, "symbol int, text string").select("symbol", F.to_timestamp("text").alias("ds"))
    found = date_spine(df, "ds", freq=alias).toPandas().groupby("symbol")["ds"].apply(lambda s: sorted(s)).to_dict()
    for i, (low, high) in enumerate(RANGES):
        expected = list(pd.date_range(low, high, freq=alias))
        assert found.get(i, []) == expected, (alias, low, high)


@pytest.mark.parametrize("alias", ["", "0D", "X", "D-MON", "W-XXX", "D3"])
def test_no_frequency(alias):
    with pytest.raises(ValueError):
        Frequency.of(alias)


def test_long_series_is_made_in_runs(spark):
    df = spark.sql("SELECT 'a' AS symbol, explode(array(timestamp'2024-01-01', timestamp'2024-01-02')) AS ds")
    spine = date_spine(df, "ds", freq="s")
    assert spine.count() == 86_401
    assert spine.select(F.spark_partition_id()).distinct().count() > 1
