import math
import random

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from wickwork.llm import topk
from wickwork.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, is_query, k, scale=1024):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(x * scale) for x in v]
            sound[i] = min(q, sound.get(i, q))
    out = []
    for i, q in sound.items():
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in sound.items() if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, Score string")


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK", [7, 50, 1000, 7][seed])
    rng = random.Random(seed)
    width = [1, 5, 16, 3][seed]
    rows = [(i, [rng.choice([-1.0, 0.5, rng.gauss(0, 1)]) for _ in range(width)]) for i in range(120)]
    rows += [(5, rows[9][1]), (None, rows[1][1]), (200, None), (201, [None] * width), (202, [float("nan")] * width), (203, [float("inf")] * width)]
    if seed == 3:
        rows += [(300, [1.0]), (301, []), (302, [3e5] * 3), (304, [3e5] * 3), (400, rows[0][1]), (401, rows[0][1])]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 4 == 0, 10)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 4 == 0, 10)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") == 0, 10)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i == 0, 10)
    assert topk.top_k(frame(spark, rows), F.col("vec_id") > 9, 10).count() == 0
    assert topk.top_k(frame(spark, rows[:1]), F.col("vec_id") == 0, 10).count() == 0
    assert topk.top_k(frame(spark, []), F.col("vec_id") == 0, 10).count() == 0


def test_query_matches_sql(spark):
    with connect(SF) as con:
        assert differences(spark, con, QUERIES["op6_top_k"], ORACLES["op6_top_k"], SF) is None
