"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's dimensions are cut into ``LISTS`` groups. For a query, each group is a list of local
scores (the products of its dimensions), and a candidate's score is the sum over the lists.

1. In every block of candidates each list hands in its k best local scores, with the whole scores
   of these candidates. The k-th best whole score of all that is gathered is a score that the
   result surely reaches.
2. That score divided by the number of lists is the uniform cutoff: a candidate below it in every
   list cannot reach the score. All entries at or above the cutoff are collected; where a part
   is missing it is below the cutoff, and what cannot reach the score even so is dropped.
3. The scores of those left are resolved exactly.

Queries and candidates are packed into blocks of at most ``BLOCK`` rows or so. Query blocks meet
candidate blocks, never the driver. Scores are 64-bit integers throughout; products go through
float64 only where no sum can exceed 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.tables import with_python, written

LISTS = 2
BLOCK = 2048
SCALE = 1024


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double; null for a vector that takes no part."""
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer matrix product left x right^T."""
    largest = float(np.abs(left, dtype=float).max(initial=0)) * float(np.abs(right, dtype=float).max(initial=0))
    if largest * max(1, left.shape[1]) < 2**53:
        return (left.astype(float) @ right.T.astype(float)).astype(np.int64)
    return left @ right.T


def _matrix(column: pa.ListArray | pa.ListScalar) -> np.ndarray:
    rows = column.values
    width = len(rows[0]) if len(rows) else 0
    return rows.flatten().to_numpy().reshape(len(rows), width)


def _pairs(batches):
    """Per row: the row, query ids and matrix, candidate ids and matrix."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            yield (
                row,
                row["q_ids"].values.to_numpy(),
                _matrix(row["q_vecs"]),
                row["c_ids"].values.to_numpy(),
                _matrix(row["c_vecs"]),
            )


def _lists(width: int) -> list[slice]:
    edges = np.linspace(0, width, LISTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_ENTRY = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), *[(f"part_{j}", pa.int64()) for j in range(LISTS)]])


def _own(q_ids: np.ndarray, c_ids: np.ndarray) -> np.ndarray:
    return q_ids[:, None] == c_ids[None, :]


def _parts(q: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    return [products(q[:, dims], c[:, dims]) for dims in _lists(q.shape[1])]


def _local_best(k: int):
    """Whole scores of each list's k best entries of a block."""

    def best(batches):
        for _, q_ids, q, c_ids, c in _pairs(batches):
            own, parts = _own(q_ids, c_ids), _parts(q, c)
            chosen = np.zeros(own.shape, bool)
            few = min(k, len(c_ids))
            for part in parts:
                ranked = np.where(own, np.iinfo(np.int64).min, part)
                np.put_along_axis(chosen, np.argpartition(ranked, -few, axis=1)[:, -few:], True, axis=1)
            at, cand = np.nonzero(chosen & ~own)
            yield _rows(_BEST, query_id=q_ids[at], vec_id=c_ids[cand], score=sum(parts)[at, cand])

    return best


def _sufficient(batches):
    """Candidates with an entry at or above their query's cutoff; entries below it are null."""
    for row, q_ids, q, c_ids, c in _pairs(batches):
        cutoff = row["cutoffs"].values.to_numpy()[:, None]
        parts = _parts(q, c)
        at, cand = np.nonzero(np.any([part >= cutoff for part in parts], axis=0) & ~_own(q_ids, c_ids))
        known = {}
        for j, part in enumerate(parts):
            values = part[at, cand]
            known[f"part_{j}"] = pa.array(values, pa.int64(), mask=values < cutoff[at, 0])
        yield _rows(_ENTRY, query_id=q_ids[at], vec_id=c_ids[cand], **known)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query.

    Ties go to the smaller vec_id; a query with fewer candidates gets all of them. Vectors that are
    null or hold null, NaN or infinite components take no part, nor do rows without vec_id. Rows
    repeating a vec_id count once, with the smallest vector. Shorter vectors are filled up with
    zeros. An empty table, or no query, gives no rows. Extra columns play no part. Scores have to fit
    into 64 bits; sums beyond that are an error.
    """
    spark = with_python(vectors.sparkSession)
    sound = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), is_query.alias("is_query"), quantised(F.col(vector), scale).alias("vec")
    ).where("vec_id is not null and vec is not null")
    sound = written(sound.groupBy("vec_id").agg(F.max("is_query").alias("is_query"), F.min("vec").alias("vec")), "topk-vectors")
    n, queries, width = sound.agg(
        F.count(F.lit(1)), F.count_if("is_query"), F.coalesce(F.max(F.size("vec")), F.lit(0))
    ).first()
    filled = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec")))
    sound = sound.withColumn("vec", filled)

    def packed(rows: DataFrame, count: int, name: str) -> DataFrame:
        """Blocks of about ``BLOCK`` rows: ids and vectors as arrays, in the same order."""
        blocks = -(-count // BLOCK) or 1
        rows = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias(f"{name}_block"), F.struct("vec_id", "vec").alias("row"))
        rows = rows.groupBy(f"{name}_block").agg(F.collect_list("row").alias("rows"))
        return rows.select(f"{name}_block", F.col("rows.vec_id").alias(f"{name}_ids"), F.col("rows.vec").alias(f"{name}_vecs"))

    asked = written(packed(sound.where("is_query"), queries, "q"), "topk-queries")
    offered = packed(sound, n, "c")
    query_blocks = -(-queries // BLOCK)
    # Every candidate block is met by every query block: one row each, then a join on the block.
    offered = offered.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))) if queries else offered.withColumn("q_block", F.lit(0))
    offered = written(offered.select(F.col("q_block").cast("long"), "c_block", "c_ids", "c_vecs"), "topk-candidates")

    pairs = offered.join(asked, "q_block").drop("c_block")
    best = pairs.drop("q_block").mapInArrow(_local_best(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reached = best.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") == k).select("query_id", F.col("score").alias("reach"))
    reached = written(reached, "topk-reached")
    # The least c with: all parts below c, hence the sum below what is reached. Exact for any long.
    floor = F.expr(f"(reach - 1 - pmod(reach - 1, {LISTS})) div {LISTS}")
    nothing = F.lit(-(2**63)).cast("long")

    numbered = asked.select("q_block", F.posexplode("q_ids").alias("at", "query_id")).join(reached, "query_id", "left")
    cutoff = F.coalesce(floor + 1, nothing)
    per_block = numbered.groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("at", cutoff.alias("cutoff")))).alias("_c"))
    bounded = pairs.join(per_block.select("q_block", F.col("_c.cutoff").alias("cutoffs")), "q_block").drop("q_block")
    parts = ", ".join(f"part_{j} long" for j in range(LISTS))
    entries = bounded.mapInArrow(_sufficient, f"query_id long, vec_id long, {parts}")
    high = sum((F.coalesce(f"part_{j}", floor) for j in range(LISTS)), F.lit(0).cast("long"))
    left = entries.join(reached, "query_id", "left").where(F.col("reach").isNull() | (high >= F.col("reach")))

    a = sound.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q_vec"))
    both = left.select("query_id", "vec_id").join(a, "query_id").join(sound.select("vec_id", "vec"), "vec_id")
    score = F.aggregate(F.zip_with("q_vec", "vec", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    exact = both.select("query_id", "vec_id", score.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
