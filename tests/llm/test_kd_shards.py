import random
import zlib

import pytest

from wickwork.llm import kd_shards as kd
from wickwork.llm.kd_shards import kd_shards
from wickwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def size(text):
    return len((text or "").encode()) + 1


def check(rows, got, shards, near):
    """Sizes, checksums, gapless slots; bytes of a shard differ from the mean by ``near`` at most."""
    want = sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    total = sum(w[1] for w in want)
    for shard in range(shards):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
        assert abs(sum(r["size"] for r in got if r.shard == shard) - total / shards) <= near
    assert {r.shard for r in got} <= set(range(shards))


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_near_equal_bytes_with_a_hot_source(spark, docs, shards):
    rng = random.Random(shards)
    rows = [
        (i, "é" * rng.randint(0, 60), rng.choice(["en", "de", None]), "hot" if rng.random() < 0.5 else f"s{i % 9}", rng.randint(0, 99))
        for i in range(1500)
    ]
    got = kd_shards(docs(*rows), shards=shards).collect()
    check([r[:2] for r in rows], got, shards, near=3 * 121)


def test_splits_follow_the_widest_dimension(spark, docs):
    rows = [(i, "x" * 9, "en", "s", i) for i in range(64)]
    got = {r.doc_id: r.shard for r in kd_shards(docs(*rows), target_bytes=160).collect()}
    assert [got[i] for i in range(64)] == [i // 16 for i in range(64)]


def brute(rows, shards):
    """The tree by plain loops. ``rows``: (id, size, values); no two rows share a value of a dimension."""
    dims = range(len(rows[0][2]))
    whole = [max(1, max(r[2][d] for r in rows) - min(r[2][d] for r in rows)) for d in dims]
    out = {}

    def split(part, first, leaves):
        if leaves == 1 or not part:
            out.update((r[0], first) for r in part)
            return
        d = max(dims, key=lambda d: ((max(r[2][d] for r in part) - min(r[2][d] for r in part)) / whole[d], -d))
        half, upto, sides = leaves // 2, 0, ([], [])
        for r in sorted(part, key=lambda r: r[2][d]):
            upto += r[1]
            sides[upto > sum(r[1] for r in part) * half / leaves].append(r)
        split(sides[0], first, half)
        split(sides[1], first + half, leaves - half)

    split(rows, 0, shards)
    return out


@pytest.mark.parametrize("shards", [2, 7, 64])
def test_tree_against_plain_loops(spark, docs, shards):
    rng = random.Random(shards)
    n = 300
    sources, lengths = rng.sample(range(n), n), rng.sample(range(10**12), n)
    rows = [(i, "x" * rng.randint(0, 40), None, f"https://example/{sources[i]:05d}", lengths[i]) for i in range(n)]
    want = brute([(i, size(rows[i][1]), (sources[i], lengths[i])) for i in range(n)], shards)
    got = kd_shards(docs(*rows), shards=shards, dimensions=["source", "n_chars"]).collect()
    assert {r.doc_id: r.shard for r in got} == want


def test_long_texts_that_begin_alike_are_told_apart(spark, docs):
    def made(prefix):
        rows = [(i, "x" * 20, "en", prefix + ("a" if i % 2 else "b"), None) for i in range(200)]
        return {r.doc_id: r.shard for r in kd_shards(docs(*rows), shards=2, dimensions=["source"]).collect()}

    short = made("")
    assert short == made("https://a-long-way-in-common/")
    assert {short[i] for i in range(1, 200, 2)} == {0} and {short[i] for i in range(0, 200, 2)} == {1}


def test_ranks_with_hot_values_and_nulls(spark, docs, monkeypatch):
    monkeypatch.setattr(kd, "HOT", 4)
    values = ["hot"] * 50 + [f"v{i % 30:02d}" for i in range(60)] + [None, "", "é", "z"]
    frame = spark.createDataFrame(list(enumerate(values)), "row long, d_0 string").repartition(5)
    order = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}
    got = {r.row: r.d_0 for r in kd.ranked(frame, "d_0").collect()}
    assert got == {i: order.get(v, -1) for i, v in enumerate(values)}


def test_edges(spark, docs):
    assert kd_shards(docs(), shards=8).count() == 0
    rows = [(1, None), (1, None), (2, ""), (None, "x" * 100_000), (3, "y"), (3, "y")]
    check(rows, kd_shards(docs(*rows), shards=8).collect(), 8, near=100_010)
    same = [(7, "same")] * 400
    check(same, kd_shards(docs(*same).withColumnRenamed("lang", "SHARD"), shards=4, dimensions=["source"]).collect(), 4, near=15)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    largest = max(size(t) for _, t in rows)
    got = QUERIES["op3_kd_shards"](spark, SF).collect()
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    check(rows, got, 8, near=3 * largest)
