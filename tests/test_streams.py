import json
import pathlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from wickwork import jobs
from wickwork.jobs import parse
from wickwork.loader import CandleLoader
from wickwork.functions.records import split_rejects
from wickwork.sources import events as ev
from wickwork.sources import ranges, tables
from wickwork.streaming import queries as streams
from wickwork.streaming.registry import StreamRegistry, StreamStopped


def send(spark, topic, *rows):
    """Events ``(minute, close)``; a text instead of a pair is sent as it is."""
    values = []
    for row in rows:
        if not isinstance(row, str):
            price = float(row[1])
            row = json.dumps({"Timestamp": f"2024-01-01 00:{row[0]:02}:00", "Low": price, "High": price, "Open": price, "Close": price, "Volume": 1.0})
        values.append((None, row.encode()))
    ev.write_events(spark.createDataFrame(values, "key binary, value binary").coalesce(1), topic, "parquet")


def closes(spark, table):
    return [(row.Timestamp.minute, row.Close) for row in tables.read_table(spark, table).orderBy("Timestamp", "Close").collect()]


@pytest.fixture()
def topic(tmp_path):
    return str(tmp_path / "topic")


def test_dedup_lasts_over_batches_and_restarts(spark, name, location, topic, tmp_path):
    tables.create_table(spark, name, location=location)

    def run():
        parsed = streams.parse_stream(ev.stream_events(spark, topic, "parquet"))
        streams.append_stream(parsed, name, name, str(tmp_path / "cp"), None).awaitTermination()

    send(spark, topic, (1, 1), (1, 1), (2, 2), "not json", '{"Timestamp": "x"}')
    run()
    assert closes(spark, name) == [(1, 1.0), (2, 2.0)]
    send(spark, topic, (2, 9), (3, 3))
    run()
    run()
    assert closes(spark, name) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_dedup_with_spread(spark, name, location, topic, tmp_path):
    tables.create_table(spark, name, location=location)
    send(spark, topic, *[(1, 1)] * 50, (2, 2), (2, 2))
    send(spark, topic, (1, 1), (5, 5))
    stream = ev.stream_events(spark, topic, "parquet", maxFilesPerTrigger="1")
    parsed = streams.parse_stream(stream, spread=3)
    streams.append_stream(parsed, name, name, str(tmp_path / "cp"), None).awaitTermination()
    assert closes(spark, name) == [(1, 1.0), (2, 2.0), (5, 5.0)]


def test_upsert_stream_corrects_and_replays(spark, name, location, topic, tmp_path):
    tables.create_table(spark, name, location=location)
    spark.sql(f"INSERT INTO {name} VALUES (timestamp'2024-01-01 00:01:00', 7, 7, 7, 7, 7, 2024)")
    send(spark, topic, (1, 1), (2, 2))
    for checkpoint in ("one", "lost"):
        parsed = streams.parse_stream(ev.stream_events(spark, topic, "parquet"))
        streams.upsert_stream(parsed, name, name, checkpoint=str(tmp_path / checkpoint), trigger=None).awaitTermination()
        assert closes(spark, name) == [(1, 1.0), (2, 2.0)]


def test_late_keys_and_corrections(spark, name, location, topic, tmp_path):
    """A late new key survives a later batch; ``update=False`` keeps the first row, else the last one counts."""
    tables.create_table(spark, name, location=location)
    checkpoint = str(tmp_path / "cp")

    def run(update):
        parsed = streams.parse_stream(ev.stream_events(spark, topic, "parquet"), distinct=False)
        streams.upsert_stream(parsed, name, name, checkpoint=checkpoint, trigger=None, update=update).awaitTermination()

    send(spark, topic, (50, 5), (51, 5))
    run(False)
    send(spark, topic, (1, 1), (2, 2), (50, 9), (52, 6))
    run(False)
    assert closes(spark, name) == [(1, 1.0), (2, 2.0), (50, 5.0), (51, 5.0), (52, 6.0)]
    send(spark, topic, (50, 9))
    run(True)
    assert closes(spark, name) == [(1, 1.0), (2, 2.0), (50, 9.0), (51, 5.0), (52, 6.0)]


def test_null_second_key_is_a_reject(spark):
    events = spark.sql("""SELECT CAST('k' AS BINARY) AS key, CAST(v AS BINARY) AS value FROM VALUES
        ('{"Timestamp": "2024-01-01 00:00:00", "Low": 1}'), ('{"Timestamp": "2024-01-01 00:00:00", "Low": null}'), ('x') t(v)""")
    good, rejects = split_rejects(events, key=("Timestamp", "Low"))
    assert (good.count(), rejects.count()) == (1, 2)


def test_servers_are_not_guessed(spark):
    with pytest.raises(ValueError, match="servers"):
        ev.read_events(spark, "topic")


def test_rejects(spark, topic, tmp_path):
    send(spark, topic, (1, 1), "not json", '{"Timestamp": "x"}')
    rejects = streams.reject_stream(ev.stream_events(spark, topic, "parquet"))
    writer = rejects.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(row.value for row in ev.peek(spark.read.parquet(str(tmp_path / "out"))).collect()) == ["not json", '{"Timestamp": "x"}']


def test_registry(spark, topic, name, tmp_path):
    send(spark, topic, (1, 1))
    registry = StreamRegistry(spark)

    def build(stream):
        events = ev.stream_events(spark, topic, "parquet")
        return events.writeStream.queryName(stream).format("noop").option("checkpointLocation", str(tmp_path / stream)).start()

    with pytest.raises(ValueError):
        registry.start("", build)
    with pytest.raises(StreamStopped):
        registry.require(name)
    assert registry.start(name, build)
    assert not registry.start(name, build)
    registry.require(name)
    assert [(row.name, row.active) for row in registry.status().where(F.col("name") == name).collect()] == [(name, True)]
    assert registry.stop(name)
    assert not registry.stop(name)
    assert not registry.stop("unknown")
    with pytest.raises(StreamStopped):
        registry.require(name)
    started = streams.start_entities(spark, {"btc": {"topic": topic}, "eth": {"topic": topic}}, lambda entity, _: build(f"{name}_{entity}"))
    assert sorted(started) == ["btc", "eth"]
    for query in started.values():
        query.stop()


def test_failure_is_raised(spark, topic, name, tmp_path):
    send(spark, topic, (1, 1))

    def fail(batch, batch_id):
        raise RuntimeError("no")

    events = ev.stream_events(spark, topic, "parquet")
    registry = StreamRegistry(spark)
    registry.start(
        name, lambda n: events.writeStream.queryName(n).foreachBatch(fail).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    with pytest.raises(Exception, match="no"):
        registry.wait(name)


# Candles by range -------------------------------------------------------------------------------

FETCH = "tests.fetches:minutes"
OPTIONS = {"symbols": "A,B", "fetch": FETCH, "start": "2024-01-01 00:00:00", "granularity": "60"}


def test_range_read(spark):
    ranges.register(spark)
    df = spark.read.format("candle_range").options(**OPTIONS, end="2024-01-01 12:00:00", chunksPerTask="1").load()
    assert df.schema == ranges.RANGE_SCHEMA
    assert df.rdd.getNumPartitions() == 6
    # Both ends, no candle twice, although the fetch gives more than was asked for.
    assert df.count() == df.distinct().count() == 2 * (12 * 60 + 1)
    ordered = df.where("Symbol = 'A'").withColumn("p", F.spark_partition_id()).collect()
    assert all(a.Timestamp < b.Timestamp for a, b in zip(ordered, ordered[1:]) if a.p == b.p)
    with pytest.raises(Exception, match="hours or less"):
        spark.read.format("candle_range").options(**OPTIONS, end="2024-01-02 00:00:00", hours="6").load().count()


def test_loader_goes_on_from_its_mark(spark, name, location):
    loader = CandleLoader(spark, name, location=location, symbol="A", start="2024-01-01 00:00:00", end="2024-01-01 06:00:00")
    assert loader.load_range(FETCH) == 361
    assert loader.load_range(FETCH) == 0
    again = CandleLoader(spark, name, location=location, symbol="A", end="2024-01-01 07:00:00")
    assert again.start == "2024-01-01 06:00:00"
    assert again.load_range(FETCH) == 60
    assert again.latest() == "2024-01-01 07:00:00"
    assert tables.read_table(spark, again.table).count() == 421
    with pytest.raises(ValueError):
        CandleLoader(spark, name, hours=6)


def test_feed_polls_without_repeats(spark, name, topic, tmp_path):
    ranges.register(spark)
    for end, rows in (("2024-01-01 01:00:00", 61), ("2024-01-01 03:30:00", 211), ("2024-01-01 03:30:00", 211)):
        feed = spark.readStream.format("candle_feed").options(**OPTIONS | {"symbols": "A"}, end=end).load()
        streams.feed_stream(feed, topic, name, "parquet", checkpoint=str(tmp_path / "cp"), trigger=None).awaitTermination()
        events = ev.read_events(spark, topic, "parquet")
        assert (events.count(), events.select("key").distinct().count()) == (rows, rows)


def test_feed_clock():
    reader = ranges.FeedReader({key.lower(): value for key, value in OPTIONS.items()} | {"buffer": "60"})
    first, latest = reader.initialOffset()["until"], reader.latestOffset()["until"]
    assert latest > first and latest % 60 == 0
    assert [run.after for run in reader.partitions({"until": first}, {"until": first + 60})] == [False, False]
    assert [run.after for run in reader.partitions({"until": first + 60}, {"until": first + 120})] == [True, True]


def test_loader_reads_events_and_consumes(spark, name, location, topic, tmp_path):
    send(spark, topic, (1, 1), (2, 2), "not json")
    loader = CandleLoader(spark, name, location=location, topic=topic, event_format="parquet")
    assert loader.load_events() == 2
    loader.consume(name, str(tmp_path / "cp"), None).awaitTermination()
    assert closes(spark, loader.table) == [(1, 1.0), (2, 2.0)]
    loader.compact([2024], 1)
    loader.consume(name, str(tmp_path / "cp2"), None, merge=False).awaitTermination()


def test_job_arguments():
    args = parse(["consume", '{"table": "btc", "topic": "btc"}', "--checkpoint", "/cp", "--once"])
    assert (args.job, args.loader["table"], args.checkpoint, args.once) == ("consume", "btc", "/cp", True)
    with pytest.raises(SystemExit):
        parse(["consume", "__import__('os')"])


def test_job_starts_as_a_script():
    script = pathlib.Path(jobs.__file__)
    done = subprocess.run([sys.executable, str(script), "--help"], cwd="/", capture_output=True, text=True, timeout=60)
    assert done.returncode == 0 and "consume" in done.stdout
