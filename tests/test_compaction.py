import threading
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wickwork.sources import tables

pytestmark = pytest.mark.usefixtures("interpreted")
SCHEMA = "n long, Timestamp timestamp, note string"


def make(spark, name, location, rows, grain="year", parts=7):
    df = spark.createDataFrame(rows, SCHEMA)
    tables.create_table(spark, name, schema=df.schema, grain=grain, location=location)
    tables.append(df.repartition(parts), name)
    return name


def of_files(spark, name, part):
    rows = tables.read_table(spark, name).where(part).withColumn("f", F.col("_metadata.file_path"))
    return [tuple(r) for r in rows.groupBy("f").agg(F.count("*"), F.min("Timestamp"), F.max("Timestamp")).orderBy(F.min("Timestamp"), F.max("Timestamp")).select("count(1)", "min(Timestamp)", "max(Timestamp)").collect()]


def test_hot_time_is_split(spark, name, location):
    hot = datetime(2023, 5, 1)
    rows = [(i, hot if i % 3 else datetime(2023, 1, 1) + timedelta(hours=i), "x") for i in range(3000)]
    rows += [(i, datetime(2024, 1, 1), "y") for i in range(50)]
    make(spark, name, location, rows)
    other = of_files(spark, name, "year = 2024")
    tables.compact(spark, name, [2023], files=6)
    files = of_files(spark, name, "year = 2023")
    assert len(files) == 6 and all(400 <= n <= 600 for n, _, _ in files)
    assert all(a[2] <= b[1] for a, b in zip(files, files[1:], strict=False))
    assert of_files(spark, name, "year = 2024") == other
    assert Counter(tuple(r) for r in tables.read_table(spark, name).drop("year").collect()) == Counter(rows)


def test_number_of_files_follows_from_bytes(spark, name, location):
    rows = [(i, datetime(2020 + (i % 10 == 0), 1, 1) + timedelta(minutes=i), f"{i * 7919 % 100003}" * 8) for i in range(8000)]
    make(spark, name, location, rows, parts=3)
    sizes = tables.file_sizes(tables.read_table(spark, name), "year").groupBy("year").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("n"))
    sizes = {r["year"]: (r["b"], r["n"]) for r in sizes.collect()}
    assert {year: n for year, (_, n) in sizes.items()} == {2020: 7200, 2021: 800}
    target = sizes[2020][0] // 5
    tables.compact(spark, name, [2020, 2021, 1999], target_bytes=target)
    files = of_files(spark, name, "year = 2020")
    assert len(files) == 5 and all(1152 <= n <= 1728 for n, _, _ in files)
    assert len(of_files(spark, name, "year = 2021")) == max(1, round(sizes[2021][0] / target))
    assert Counter(tuple(r) for r in tables.read_table(spark, name).drop("year").collect()) == Counter(rows)


def test_few_rows_and_equal_rows(spark, name, location):
    rows = [(1, datetime(2020, 1, 1), "same")] * 9
    make(spark, name, location, rows)
    tables.compact(spark, name, [2020], files=4)
    assert tables.read_table(spark, name).count() == 9
    assert len(of_files(spark, name, "year = 2020")) == 1  # identical rows stay together
    tables.compact(spark, name, [2031], files=4)
    tables.compact(spark, name, [2031])
    assert tables.read_table(spark, name).count() == 9


def test_bins_are_found_by_halving(spark):
    cuts = F.array(*[F.lit(c).cast("bigint") for c in (3, 5, 5, 9, 20)])
    got = spark.range(25).select(tables._bin(F.col("id"), cuts, 5).alias("bin")).collect()
    assert [r["bin"] for r in got] == [sum(c < i for c in (3, 5, 5, 9, 20)) for i in range(25)]


@pytest.mark.parametrize("grain", ["year", "month", "day"])
def test_bounds_read_two_partitions(spark, name, location, grain):
    rows = [(i, datetime(2020, 1, 1) + timedelta(days=40 * i), "x") for i in range(30)]
    make(spark, name, location, rows, grain=grain)
    assert tuple(tables.table_bounds(spark, name).first()) == (rows[0][1], rows[-1][1])
    read = tables.table_bounds(spark, name).inputFiles()
    values = {path.split(f"{grain}=")[1].split("/")[0] for path in read}
    every = tables.partition_values(spark, name, grain)
    assert values <= {every[0], every[-1]} and len(every) > 2
    assert tables.latest_mark(spark, name) == rows[-1][1].strftime("%Y-%m-%d %H:%M:%S")


def test_bounds_skip_partitions_without_rows(spark, name, location):
    rows = [(i, datetime(2020 + i, 1, 1), "x") for i in range(4)]
    make(spark, name, location, rows)
    spark.sql(f"INSERT INTO {name} VALUES (9, NULL, 'x', 2030)")
    spark.sql(f"INSERT INTO {name} VALUES (9, NULL, 'x', NULL)")
    spark.sql(f"ALTER TABLE {name} ADD PARTITION (year = 2040)")
    assert tuple(tables.table_bounds(spark, name).first()) == (rows[0][1], rows[-1][1])


def test_bounds_of_an_empty_table(spark, name, location):
    tables.create_table(spark, name, location=location)
    assert tuple(tables.table_bounds(spark, name).first()) == (None, None)


def test_sessions_do_not_wait_for_each_other(spark):
    """A setting held for one session's write does not keep another session from writing."""
    other, key = spark.newSession(), "spark.sql.files.maxRecordsPerFile"
    entered = []

    def write():
        with tables._settings(other, **{key: "7"}):
            entered.append(other.conf.get(key))

    with tables._settings(spark, **{key: "5"}):
        thread = threading.Thread(target=write)
        thread.start()
        thread.join(20)
        assert entered == ["7"] and spark.conf.get(key) == "5"
    assert other.conf.get(key) == "0"
