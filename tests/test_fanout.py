import json

import pytest

from wickwork.sources import events as ev
from wickwork.sources import tables
from wickwork.streaming import fanout


def event(topic, minute, close, text=None):
    price = float(close)
    body = {"Timestamp": f"2024-01-01 00:{minute:02}:00", "Low": price, "High": price, "Open": price, "Close": price, "Volume": 1.0}
    return (topic, None, (text or json.dumps(body)).encode())


def send(spark, root, *rows):
    fanout.write_topics(spark.createDataFrame(rows, "topic string, key binary, value binary").coalesce(1), root)


def closes(spark, table):
    return [(row.Timestamp.minute, row.Close) for row in tables.read_table(spark, table).orderBy("Timestamp").collect()]


@pytest.fixture()
def two(spark, name, tmp_path):
    made = {topic: f"{name}_{topic}" for topic in ("btc", "eth")}
    for table in made.values():
        tables.create_table(spark, table, location=str(tmp_path / table))
    return made


def test_topics_to_their_tables(spark, two, name, tmp_path):
    root, path = str(tmp_path / "topics"), str(tmp_path / "progress")
    listener = fanout.ProgressTable(spark, path, name, list(two))
    spark.streams.addListener(listener)

    def run(checkpoint="cp"):
        events = fanout.stream_topics(spark, list(two), "parquet", root=root)
        fanout.fanout_stream(events, two, name, checkpoint=str(tmp_path / checkpoint), trigger=None).awaitTermination()
        assert listener.ended.wait(60)

    try:
        send(spark, root, event("btc", 1, 1), event("eth", 1, 10), event("btc", 2, 2), event("doge", 1, 5), event("btc", 0, 0, "not json"))
        run()
        assert closes(spark, two["btc"]) == [(1, 1.0), (2, 2.0)] and closes(spark, two["eth"]) == [(1, 10.0)]
        # One checkpoint for both: a restart goes on where it was, with corrections.
        send(spark, root, event("eth", 1, 11), event("eth", 3, 13), event("eth", 0, 0, '{"Timestamp": null}'))
        run()
        assert closes(spark, two["btc"]) == [(1, 1.0), (2, 2.0)] and closes(spark, two["eth"]) == [(1, 11.0), (3, 13.0)]
        run()
    finally:
        spark.streams.removeListener(listener)
    got = {r["topic"]: (r["batches"], r["rows"], r["rejects"], r["latest"].minute) for r in fanout.progress(spark, path).collect()}
    assert got == {"btc": (2, 2, 1, 2), "eth": (2, 3, 1, 3)}
    before = {topic: closes(spark, table) for topic, table in two.items()}
    events = fanout.stream_topics(spark, list(two), "parquet", root=root)
    fanout.fanout_stream(events, two, f"{name}_again", checkpoint=str(tmp_path / "lost"), trigger=None).awaitTermination()
    assert {topic for topic, rows in before.items() if [m for m, _ in rows] != [m for m, _ in closes(spark, two[topic])]} == set()


class Recorder:
    """Stands for a reader or writer of a broker, and notes what it is told."""

    def __init__(self):
        self.told, self.read, self.readStream, self.write = {}, self, self, self

    def format(self, name):
        self.told["format"] = name
        return self

    def options(self, **options):
        self.told |= options
        return self

    def load(self, *path):
        self.told["load"] = path
        return self

    def save(self, *path):
        self.told["save"] = path

    def select(self, *columns):
        self.told["columns"] = columns
        return self


BROKER = {"format": "kafka", "kafka.bootstrap.servers": "a:9092,b:9092"}


def test_broker_options():
    reader = Recorder()
    ev.read_events(reader, "btc", servers="a:9092,b:9092")
    assert reader.told == BROKER | {"subscribe": "btc", "load": ()}
    reader = Recorder()
    ev.stream_events(reader, "btc", servers="a:9092,b:9092", maxOffsetsPerTrigger="1000")
    assert reader.told == BROKER | {"subscribe": "btc", "startingOffsets": "earliest", "maxOffsetsPerTrigger": "1000", "load": ()}
    reader = Recorder()
    fanout.stream_topics(reader, ["btc", "eth"], servers="a:9092,b:9092", startingOffsets="latest")
    assert reader.told == BROKER | {"subscribe": "btc,eth", "startingOffsets": "latest", "load": (), "columns": ("topic", "key", "value")}
    writer = Recorder()
    ev.write_events(writer, "btc", servers="a:9092,b:9092")
    assert writer.told == BROKER | {"topic": "btc", "save": ()}
    with pytest.raises(ValueError, match="servers"):
        fanout.stream_topics(Recorder(), ["btc"])
