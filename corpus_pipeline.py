"""Documents to training tokens: five stages, each written as Parquet and reread as the next one's documents.

Every stage works on all that its predecessor kept, and all but the last return the columns of the
documents: rejected, duplicate and contaminated documents are gone, personal data are replaced in
the text, and the last stage adds token ids and the bytes they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wickwork.llm import byte_bpe, decontaminate, kneser_ney, near_dedup, personal_data
from wickwork.llm.queries import trusted
from wickwork.llm.tables import table, written
from wickwork.session import use_utc

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is at most their language's threshold."""
    judged = kneser_ney.quality(docs, trusted(spark, sf_dir))
    return judged.where(judged[judged.columns[-1]]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 on five-word shingles connect."""
    return near_dedup.deduplicated(docs, width=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark questions."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by their kind."""
    return personal_data.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the bytes they decode to."""
    return byte_bpe.encode_decode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", redaction),
    ("byte_bpe", encode),
]

#: Perplexities, components and tokens are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(use_utc(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
