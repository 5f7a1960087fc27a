"""Documents whose further columns are called like the operators' own: they come back as they were."""

import pytest
from pyspark.sql import functions as F

from wickwork.llm import byte_bpe, decontaminate, ftrl, kneser_ney, near_dedup, periodic_runs, personal_data, token_counts

NAMES = [
    "_id", "_label", "_own", "_lang", "_text", "_text_hash", "_hash", "_of", "_n", "_p", "_cut", "_all", "_marked", "chunk", "gram", "logp",
    "canon", "blind", "raw", "hash", "found", "word", "n", "text_hash", "component_id", "n_shingles", "item_id", "_names", "_values", "AT", "ORDER",
]

OPERATORS = {
    "ftrl": lambda docs, ids, bench: ftrl.toxicity(docs, ids.withColumn("toxic", F.lit(1))),
    "kneser_ney": lambda docs, ids, bench: kneser_ney.quality(docs, ids),
    "near_dedup": lambda docs, ids, bench: near_dedup.deduplicated(docs, 2, 80),
    "decontaminate": lambda docs, ids, bench: decontaminate.decontaminated(docs, bench),
    "redact": lambda docs, ids, bench: personal_data.redact(docs),
    "byte_bpe": lambda docs, ids, bench: byte_bpe.encode_decode(docs),
    "token_counts": lambda docs, ids, bench: token_counts.token_counts(docs),
    "periodic_runs": lambda docs, ids, bench: periodic_runs.periodic_runs(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_come_back(spark, docs, name):
    texts = [f"a text about {w} and {w} again, of {w}s many" for w in ("trees", "rivers", "houses", "winds", "clouds", "roads")]
    rows = docs(*[(i, text, "en", "s") for i, text in enumerate(texts)], (90, None), (91, ""))
    rows = rows.withColumns({column: F.concat(F.lit(f"{column}-"), F.coalesce("doc_id", F.lit(0))) for column in NAMES})
    table = spark.createDataFrame([(1, "where is the tower that stands in the middle of town")], "item_id long, text string")
    out = OPERATORS[name](rows, rows.select("doc_id"), table)
    assert set(NAMES) <= set(out.columns)
    got = out.select("doc_id", *NAMES).collect()
    assert len(got) == 8
    for row in got:
        assert [row[column] for column in NAMES] == [f"{column}-{row['doc_id']}" for column in NAMES]
