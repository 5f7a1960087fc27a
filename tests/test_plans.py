"""What the plans must keep to, whatever the data: no series in one task, no join to a calendar."""

import re

import pytest

from wickwork.operators import fills, frames
from wickwork.operators import candles as cd
from wickwork.queries import QUERIES, minutely, ticks

SF = "/root/testdata/sf0.001"
# These write and read back; their plan is a scan.
WRITING = {
    "table_roundtrip", "batch_from_kafka_json", "chunked_range_read", "stream_feed", "append_batch", "year_partitioned_table",
    "table_range_scan", "compact_partition", "upsert_by_timestamp", "load_count", "stream_dedup", "stream_append_table", "stream_upsert",
    "stream_dedup_late", "stream_upsert_last", "stream_monotonic", "stream_candles", "compact_hot_time", "table_bounds",
    "stream_fanout", "stream_progress",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - WRITING))
def test_no_plan_gathers_or_multiplies(spark, key):
    text = plan(QUERIES[key](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text
    # One row per table at most goes to a single partition: global aggregates.
    if "Exchange SinglePartition" in text:
        assert key in ("latest_timestamp", "latest_timestamp_default")


@pytest.mark.parametrize(
    "make",
    [
        lambda df: fills.fill_forward(df, "close", "ts", freq="min", regular=True),
        lambda df: fills.fill_backward(df, "close", "ts", freq="min", regular=True),
        lambda df: fills.fill_rows(df, "ts", freq="min", regular=True),
        lambda df: fills.asof_next(df, "ts", freq="min", regular=True),
        lambda df: frames.univariate(df, "close", 3, 2),
        lambda df: frames.lag_lead(df, ["close"], [1], [1]),
        lambda df: cd.monotonic_filter(df, "close", "ts"),
    ],
)
def test_windows_over_rows_are_cut_into_blocks(spark, make):
    """No window has a series to itself: all are by block, or by group of block summaries."""
    df = make(spark.createDataFrame([], minutely(spark, SF).schema))
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan(df))
    assert windows
    assert any("_block" in keys for keys in windows)
    assert all("symbol" in keys and ("_block" in keys or re.search(r"_nu+#", keys)) for keys in windows)
    assert "Join" not in plan(df)


ONE_SCAN = [
    "gapfill_forward", "gapfill_backward", "gapfill_row", "asof_next", "lag_lead", "monotonic_filter", "supervised_full",
    "supervised_single", "seq_univariate", "seq_classification", "seq_forecast", "seq_multivariate",
]


@pytest.mark.parametrize("key", ONE_SCAN)
def test_source_is_read_once(spark, key):
    """Block summaries are made from the exchange that the rows go through."""
    df = QUERIES[key](spark, SF)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert text.count("FileScan") == 1
    assert "ReusedExchange" in text


def test_rows_are_shuffled_once(spark):
    df = spark.createDataFrame([], "symbol string, ts timestamp, close double, volume double")
    text = plan(fills.fill_forward(df, "close", "ts", freq="min", regular=True))
    # Rows once by block, for both of their uses; the others are of summaries and edges.
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)
    assert sum("_block" in keys for keys in exchanges) == 3 and len(exchanges) == 4
    df = QUERIES["gapfill_forward"](spark, SF)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert text.count("ReusedExchange") == 1


def test_gap_free_frames_shuffle_once(spark):
    df = spark.createDataFrame([], "symbol string, ts timestamp, close double, volume double")
    assert plan(frames.univariate(df, "close", 3, 2, gap_free="min")).count("Exchange hashpartitioning") == 1


def test_scans_read_what_they_need(spark):
    text = plan(cd.latest_timestamp(ticks(spark, SF)))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz>", text)
    text = plan(QUERIES["ohlcv_candles"](spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    assert "partial_max_by" in text


@pytest.mark.parametrize("fan", [2, 3])
def test_tree_of_summaries(spark, monkeypatch, fan):
    """With a small fan there are many levels; what is carried stays the same."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from wickwork.plans import blocks

    monkeypatch.setattr(blocks, "FAN", fan)
    rows = spark.range(200).select(
        (F.col("id") % 2).alias("symbol"), (F.col("id") * F.col("id") % 211 - 100).alias("at"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v")
    )
    rows = rows.dropDuplicates(["symbol", "at"])
    # Twenty blocks of ten, some numbers beyond the limits.
    edged = blocks.with_edges(rows, ["symbol"], "at", 10, ["v"], maxima=["v"], counted="n", anchor="first", ahead=True, limits=(-60, 60))
    found = {(r["symbol"], r["_block"], r["_edge"]): r for r in edged.where("_edge <> 0").collect()}
    data = [tuple(r) for r in rows.select("symbol", "at", "v").collect()]
    for (symbol, block, side), row in found.items():
        mine = sorted((at, v) for s, at, v in data if s == symbol)
        if side == -1:
            before = [r for r in mine if r[0] < block * 10]
            values = [v for _, v in before if v is not None]
            assert row["at"] == (before[-1][0] if before else None)
            # The last known value and the largest one share a column here; the later entry wins.
            assert row["v"] == (max(values) if values else None)
            assert (row["n"], row["first"]) == (len(before), mine[0][0])
        else:
            behind = [r for r in mine if r[0] >= block * 10 + 10]
            values = [v for _, v in behind if v is not None]
            assert row["at"] == (behind[0][0] if behind else None)
            assert row["v"] == (values[0] if values else None)
    assert len(found) == 2 * len({(s, at // 10) for s, at, _ in data})
