import glob
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wickwork.schema import CANDLE_SCHEMA
from wickwork.sources import tables


def candles(spark, start: str, days: int, close: float = 1.0):
    """One candle per day."""
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(start), "yyyy-MM-dd") + F.col("id") * 86_400)
    price = F.lit(close).cast("float")
    return spark.range(days).select(ts.alias("Timestamp"), *[price.alias(name) for name in CANDLE_SCHEMA.fieldNames()[1:]])


def files(location: str) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for path in sorted(glob.glob(f"{location}/*/*.parquet")):
        found.setdefault(os.path.basename(os.path.dirname(path)), []).append(os.path.basename(path))
    return found


@pytest.mark.parametrize("use_sql", [True, False])
def test_create_append_latest(spark, name, location, use_sql):
    assert tables.latest_mark(spark, name) == "2014-01-01 00:00:00"
    assert tables.create_table(spark, name, location=location, use_sql=use_sql)
    assert not tables.create_table(spark, name, location=location, use_sql=use_sql)
    assert tables.latest_mark(spark, name) == "2014-01-01 00:00:00"
    counted = Observation()
    tables.append(candles(spark, "2023-12-01", 60), name, max_rows_per_file=10, observe_as=counted)
    assert counted.get["rows"] == 60
    assert tables.latest_mark(spark, name) == "2024-01-29 00:00:00"
    assert {part: len(names) for part, names in files(location).items()} == {"year=2023": 4, "year=2024": 3}
    assert tables.read_table(spark, name).drop("year").schema.simpleString() == CANDLE_SCHEMA.simpleString()


def test_namespace(spark, name):
    tables.use_namespace(spark, name, "spark_catalog")
    tables.use_namespace(spark, name)
    assert spark.catalog.databaseExists(name)
    assert tables.create_table(spark, f"{name}.candles")
    assert spark.catalog.tableExists(f"{name}.candles")


def test_range_reads_only_its_partitions(spark, name, location):
    tables.create_table(spark, name, location=location)
    tables.append(candles(spark, "2020-01-01", 2000), name)
    found = tables.read_range(spark, name, "2021-06-01", "2022-02-01")
    assert found.count() == 245
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year#" in plan.split("PartitionFilters")[1].split("]")[0]
    read = {os.path.basename(os.path.dirname(path)) for path in found.inputFiles()}
    assert read == {"year=2021", "year=2022"}


@pytest.mark.parametrize("grain", ["year", "month", "day"])
def test_upsert(spark, name, location, grain):
    days = 800 if grain == "year" else 70
    tables.create_table(spark, name, location=location, grain=grain)
    tables.append(candles(spark, "2022-01-01", days, 1.0), name)
    before = files(location)
    # Ten days which are there, then new ones; and a row without key.
    start = str(spark.sql(f"SELECT date_add(date'2022-01-01', {days - 10})").first()[0])
    null_key = candles(spark, start, 1, 3.0).withColumn("Timestamp", F.lit(None).cast("timestamp"))
    source = candles(spark, start, 400 if grain == "year" else 40, 2.0).unionByName(null_key)
    for _ in range(2):
        tables.upsert(source, name)
        after = spark.table(name)
        assert after.where("Close = 1").count() == days - 10
        assert after.where("Close = 2").count() == (400 if grain == "year" else 40)
        assert after.where("Close = 3").count() == 0
        untouched = {"year": "year=2022", "month": "month=2022-01", "day": "day=2022-01-31"}[grain]
        assert files(location)[untouched] == before[untouched]


def test_upsert_of_new_rows_only_appends(spark, name, location):
    tables.create_table(spark, name, location=location)
    tables.append(candles(spark, "2024-01-01", 30), name)
    before = files(location)["year=2024"]
    tables.upsert(candles(spark, "2024-02-01", 30), name)
    assert set(before) < set(files(location)["year=2024"])
    assert spark.table(name).count() == 60
    tables.upsert(candles(spark, "2024-02-01", 0), name)
    assert spark.table(name).count() == 60


def test_compact(spark, name, location):
    tables.create_table(spark, name, location=location)
    for part in range(4):
        tables.append(candles(spark, "2020-01-01", 1200).where(F.pmod(F.dayofyear("Timestamp"), F.lit(4)) == part), name)
    before, rows = files(location), spark.table(name).orderBy("Timestamp").collect()
    tables.compact(spark, name, [2020, 2021, 2021], 3)
    after = files(location)
    assert [len(after[f"year={year}"]) for year in (2020, 2021)] == [3, 3]
    assert [after[f"year={year}"] for year in (2022, 2023)] == [before[f"year={year}"] for year in (2022, 2023)]
    assert spark.table(name).orderBy("Timestamp").collect() == rows
    # Files follow each other in time.
    spans = (
        spark.table(name).where("year = 2021").groupBy(F.input_file_name().alias("f")).agg(F.min("Timestamp").alias("a"), F.max("Timestamp").alias("b"))
    ).orderBy("a").collect()
    assert all(one.b < two.a for one, two in zip(spans, spans[1:]))
    tables.compact(spark, name, [2022], 1)
    assert len(files(location)["year=2022"]) == 1
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_upsert_needs_a_partitioned_table(spark, name):
    spark.sql(f"CREATE TABLE {name} (Timestamp TIMESTAMP) USING parquet")
    with pytest.raises(ValueError):
        tables.upsert(spark.sql("SELECT timestamp'2024-01-01' AS Timestamp"), name)


def test_upsert_needs_the_time_and_reduces_copies(spark, name, location):
    tables.create_table(spark, name, location=location)
    rows = candles(spark, "2024-01-01", 2)
    tables.upsert(rows.unionByName(candles(spark, "2024-01-01", 2, 3.0)), name)
    assert [r.Close for r in tables.read_table(spark, name).collect()] == [3.0, 3.0]
    with pytest.raises(ValueError, match="Timestamp"):
        tables.upsert(rows, name, keys=("Close",))
    tables.upsert(candles(spark, "2024-01-02", 2, 9.0), name, update=False)
    assert sorted(r.Close for r in tables.read_table(spark, name).collect()) == [3.0, 3.0, 9.0]
    tables.compact(spark, name, [], 2)


def test_statements_are_sql(spark):
    parse = spark._jsparkSession.sessionState().sqlParser().parsePlan
    for fmt in ("parquet", "iceberg", "delta", "hudi"):
        text = tables.create_statement("a.b", fmt, CANDLE_SCHEMA)
        parse(text)
        assert ("years(`Timestamp`)" in text) == (fmt == "iceberg")
    for update in (True, False):
        plan = parse(tables.merge_statement("t", ["Timestamp", "Symbol"], update).format(source="x")).toString()
        assert "MergeIntoTable" in plan and ("updatestar" in plan) == update


def test_compact_by_text_values(spark, name, location):
    tables.create_table(spark, name, location=location)
    for start in ("2023-01-01", "2023-06-01", "2024-01-01"):
        tables.append(candles(spark, start, 5), name)
    tables.compact(spark, name, ["2023"], 1)
    assert {part: len(names) for part, names in files(location).items()} == {"year=2023": 1, "year=2024": 1}
    assert tables.read_table(spark, name).count() == 15
