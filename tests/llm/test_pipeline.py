"""Stages against brute force on the smallest tables, each on its own input."""

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import connect, differences
from tests.llm.test_near_dedup import brute
from wickwork.llm import byte_bpe, kneser_ney, personal_data
from wickwork.llm.queries import ORACLES, QUERIES, trusted
from wickwork.llm.tables import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]
    for frame in outputs[1:-1]:
        assert frame.columns == outputs[0].columns


def test_quality(spark, outputs):
    judged = rows(kneser_ney.quality(outputs[0], trusted(spark, SF)))
    kept = rows(outputs[1])
    assert set(kept) == {d for d, r in judged.items() if r.kept}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()
    assert sum(r.doc_id in kept for r in labels) >= 0.95 * len(labels)


def test_near_duplicates(outputs):
    before, after = rows(outputs[1]), rows(outputs[2])
    groups = brute([(d, r.text) for d, r in before.items()], 5, 80)
    assert set(after) == {d for d, n, first in groups if d == first or n == 0}


def test_decontamination(spark, outputs):
    before, after = rows(outputs[2]), rows(outputs[3])
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {d for d, r in before.items() for i in items if f" {' '.join(i)} " in f" {' '.join(r.text.lower().split())} "}
    assert whole and not whole & set(after)
    tokens = {d: r.text.lower().split() for d, r in before.items()}
    eights = {tuple(i[k : k + 8]) for i in items for k in range(len(i) - 7)}
    for d in set(before) - set(after):
        assert any(tuple(tokens[d][k : k + 8]) in eights for k in range(len(tokens[d]) - 7))


def test_personal_data(outputs):
    before, after = rows(outputs[3]), rows(outputs[4])
    assert set(before) == set(after)
    for d, r in after.items():
        assert r.text == personal_data.redacted(before[d].text)
        assert r.n_chars == len(r.text)
        assert not [s for s in personal_data.find(r.text) if s[0] == "email"]


def test_tokens(outputs):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    judge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = rows(outputs[4])
    after = rows(outputs[5])
    assert set(before) == set(after)
    for d, r in after.items():
        assert r.token_ids == judge.encode_ordinary(before[d].text)
        assert bytes(r.decoded) == before[d].text.encode()


def test_run_is_the_stages_in_turn(spark, outputs):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == outputs[-1].columns
    key = lambda frame: frame.agg(F.count("*"), F.bit_xor(F.xxhash64("doc_id", "text", "n_tokens"))).first()
    assert key(got) == key(outputs[-1])


def test_empty_table(spark, outputs):
    docs = outputs[0].where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_sql(spark, key):
    with connect(SF) as con:
        assert differences(spark, con, QUERIES[key], ORACLES[key], SF) is None


def test_registered():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(entry.oracle_sql()) <= names
