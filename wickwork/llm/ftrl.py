"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours, and pairs with one word between,
hashed to ``1 << BITS`` coordinates. FTRL-proximal keeps a learning rate of its own for each
coordinate and soft-thresholds by L1, so most weights are exactly zero; the others, at most
``1 << BITS`` of 12 bytes each, are what is broadcast for scoring.

Learning is sequential by nature. It runs in one task over a sample of at most ``SAMPLE`` labelled
rows, chosen by a hash of the id and in that order, from the slim label table before any text is
read. Scoring covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickwork.llm.tables import free_name, with_python, written

BITS = 18
#: Labelled rows that are learnt from, at most.
SAMPLE = 20_000
EPOCHS = 10
#: A text has a thousand features or so, most of them rare; L1 keeps those from sharing in what is learnt.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.1
THRESHOLD = 0.7
#: Characters hashed together in a task.
GROUP_CHARS = 500_000

WORD = re.compile(r"\w+")
_MASK = np.uint64((1 << BITS) - 1)
_KIND = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def features(text: str) -> np.ndarray:
    """Sorted distinct coordinates of a text; coordinate 0 is the bias."""
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, WORD.findall(text.lower())), np.uint64)
    found = [np.zeros(1, np.uint64)]
    for gap, kind in enumerate(_KIND):
        if len(hashed) > gap:
            key = hashed * kind if gap == 0 else hashed[:-gap] * kind + (hashed[gap:] ^ kind)
            key = (key ^ (key >> np.uint64(29))) * _KIND[1]
            found.append(np.maximum((key >> np.uint64(64 - BITS)) & _MASK, np.uint64(1)))
    return np.unique(np.concatenate(found)).astype(np.int64)


def learn(rows: Iterable[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over (coordinates, label)."""
    rows = list(rows)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        strong = np.abs(z[at]) > L1
        return np.where(strong, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for at, label in rows:
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    return weights(np.arange(1 << BITS))


def sample(labels: DataFrame, doc_id: str, label: str, size: int) -> DataFrame:
    """(_id, _label): at most ``size`` labelled ids, those with the smallest hashes."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    return known.orderBy(F.xxhash64("_id"), "_id").limit(size)


def fit(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", size: int = SAMPLE) -> DataFrame:
    """(coordinate, weight) of the weights that are not zero, learnt from the texts of ``labels``' sample."""
    with_python(docs.sparkSession)
    chosen = written(sample(labels, doc_id, label, size), "ftrl-sample")
    # At most ``size`` ids.
    texts = docs.select(F.col(doc_id).alias("_of"), F.coalesce(text, F.lit("")).alias("_text"))
    texts = texts.join(F.broadcast(chosen), F.col("_of") == F.col("_id")).select("_id", "_label", "_text")

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def coordinates(column: pa.Array) -> pa.Array:
        return pa.array([features(v.as_py()) for v in column], pa.list_(pa.int64()))

    # Repeated ids: one text, so that the sample stays within its bound.
    rows = texts.groupBy("_id").agg(F.min("_label").alias("_label"), F.min("_text").alias("_text"))
    rows = rows.select(F.lit(0).alias("all"), F.xxhash64("_id").alias("order"), "_id", "_label", coordinates("_text").alias("at"))

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("_id", "ascending")])
        at = [v.values.to_numpy() for v in table.column("at")]
        weights = learn(zip(at, table.column("_label").to_pylist(), strict=True))
        kept = np.flatnonzero(weights)
        return pa.table({"coordinate": kept, "weight": weights[kept]})

    return rows.groupBy("all").applyInArrow(train, "coordinate long, weight double")


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All columns of ``docs``, score (0 to 1) and predicted (1 from ``threshold`` on).

    The score depends on the text alone. Null and empty texts have the score of the bias. Labels that
    contradict each other count as the higher one; null labels and ids are not learnt from, and of
    rows that share a labelled id the smallest text is. Without labels every score is 0.5. Ties and repeated rows
    need no rule in scoring. New columns whose names are taken get underscores appended.
    """
    spark = with_python(docs.sparkSession)
    model = fit(docs, labels, label, doc_id, text).toArrow()  # at most 1 << BITS rows
    weights = np.zeros(1 << BITS)
    weights[model.column("coordinate").to_numpy()] = model.column("weight").to_numpy()
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        sums = np.array([shared.value[features(v.as_py() or "")].sum() for v in column])
        return pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())

    name, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    return docs.withColumn(name, score(text)).withColumn(predicted, (F.col(name) >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
