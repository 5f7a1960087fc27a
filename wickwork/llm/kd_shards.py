"""Shards of near equal bytes by a k-d tree over document metadata.

Each node of the tree holds a box of documents and a run of leaves, ``first`` and as many as
``leaves``. It is split at the weighted median (weights are bytes; at the matching fraction where its
leaves are an odd number) along the dimension in which its box is widest, measured as a share of the
whole range of that dimension, until each node is one leaf of at most the target bytes.

Medians are found for all nodes of a level at once by distributed histograms: bytes per node and
bin, bins narrowed around the median until it is one value. A value that many documents share (a
source with a third of all rows) is then split by a hash of the row in the same way, so the halves
stay equal. Nodes and their splits are tables that the rows are joined with, and a node's bins meet
in the cluster: the driver gets the root's box, and whether a step is the last one. Slots are
numbered from counts of small chunks, so no shard passes through one task.

Texts are compared by their rank among the distinct values of their dimension.

DataFrame functions only. What is scanned again and again is a slim written table of numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickwork.llm.tables import written

BIN_BITS = 12
#: A bin with at most this share of a node's bytes is not narrowed further.
FINE = 1e-5
#: Rows numbered together.
CHUNK_BITS = 13
#: Values with more than one in so many rows are looked up apart; there are fewer than that.
HOT = 1000
DIMENSIONS = ("lang", "source", "n_chars")


def numeric(df: DataFrame, name: str) -> Column:
    """A dimension as a long in its own order: numbers (fractions rounded down), times by
    microseconds. Null comes first; very large values count as 2^61."""
    kind = dict(df.dtypes)[name]
    col = F.col(name)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        value = col.cast("long")
    elif kind in ("float", "double") or kind.startswith("decimal"):
        value = F.floor(F.greatest(F.least(F.nanvl(col.cast("double"), F.lit(0.0)), F.lit(2.0**61)), F.lit(-(2.0**61))))
    else:
        value = F.unix_micros(col.cast("timestamp"))
    return F.coalesce(F.greatest(F.least(value, F.lit(2**61)), F.lit(1 - 2**61)), F.lit(-(2**61)))


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the texts of column ``name`` replaced by their rank in the order of their UTF-8
    bytes, from 0; null is -1. Distinct values are sorted by range; where a part of them begins is a
    sum over the parts. Hot values are looked up in a table of fewer than ``HOT`` rows, so that none
    of them is a join key of its own."""
    columns = rows.columns
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    values = written(counts.orderBy("_value").withColumn("_at", F.monotonically_increasing_id()), "shards-values")
    part = F.shiftright("_at", 33)
    parts = values.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_rows").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_at") - F.shiftleft(part, 33)
    ranks = values.join(parts, part == F.col("_part")).select("_value", "_rows", (F.col("_start") + within).alias("_rank"))
    ranks = written(ranks, "shards-ranks")
    total = ranks.agg(F.sum("_rows").alias("total")).first()["total"] or 0
    hot = ranks.where(F.col("_rows") * HOT > total).select(F.col("_value").alias("_hot"), F.col("_rank").alias("_hot_rank"))
    rows = rows.join(F.broadcast(hot), F.col(name) == F.col("_hot"), "left")
    # Rows that need no further look-up are spread over all tasks by keys that match nothing.
    found = F.col("_hot").isNotNull() | F.col(name).isNull()
    rows = rows.withColumn("_spread", F.when(found, F.col("row") + 1).otherwise(0))
    rows = rows.join(ranks.withColumn("_none", F.lit(0).cast("long")), (F.col(name) == F.col("_value")) & (F.col("_spread") == F.col("_none")), "left")
    rank = F.coalesce("_hot_rank", "_rank", F.lit(-1)).cast("long")
    return rows.select(*[rank.alias(c) if c == name else F.col(c) for c in columns])


def _met(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows with their node's split, and their value in its dimension as ``_dim``."""
    names = [c for c in rows.columns if c.startswith("d_")]
    return rows.join(splits, "first").withColumn("_dim", F.element_at(F.array(*names), F.col("dim") + 1))


def _narrowed(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """``splits`` narrowed around their medians, until a bin is one value or holds next to nothing.

    Each pass aggregates the slim table into at most 2^BIN_BITS bins per open split, and a running sum
    over these finds the bin that holds the median. ``before`` bytes of a node are below ``lo``; a bin
    that is not narrowed further goes left as a whole if most of it has to.
    """
    bits = F.length(F.bin(F.col("hi") - F.col("lo")))
    bin_ = F.struct("bin", "bin_lo", "bin_hi", "in_bin", (F.col("upto") - F.col("in_bin")).alias("below"))
    upto = F.col("before") + F.sum("in_bin").over(Window.partitionBy("first").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    one = F.col("_m.bin_lo") == F.col("_m.bin_hi")
    done = one | (F.col("_m.in_bin") <= FINE * F.col("bytes"))
    whole = done & ~one & (F.col("target") - F.col("_m.below") > F.col("_m.in_bin") / 2)
    changed = {
        "lo": F.when(whole, F.col("_m.bin_hi") + 1).otherwise(F.col("_m.bin_lo")),
        "hi": F.col("_m.bin_hi"),
        "before": F.col("_m.below"),
        "done": done,
    }
    while not splits.where("not done").isEmpty():
        open_ = splits.where("not done")
        steps = open_.withColumn("shift", F.greatest(F.lit(0), bits - BIN_BITS).cast("int"))
        inside = _met(rows, steps).where(F.col(key).between(F.col("lo"), F.col("hi")) & (F.col("value").isNull() | (F.col("_dim") == F.col("value"))))
        bins = inside.groupBy("first", F.expr(f"shiftright({key} - lo, shift)").alias("bin")).agg(
            F.sum("size").alias("in_bin"), F.min(key).alias("bin_lo"), F.max(key).alias("bin_hi")
        )
        bins = bins.join(open_.select("first", "before", "target"), "first").withColumn("upto", upto)
        median = bins.groupBy("first").agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("target"), bin_)), F.max(bin_)).alias("_m"))
        after = open_.join(median, "first").select(*[changed.get(c, F.col(c)).alias(c) for c in splits.columns])
        splits = written(splits.where("done").unionByName(after), "shards-splits")
    return splits


def _halved(rows: DataFrame, names: Sequence[str], ranges: dict[str, int]) -> DataFrame:
    """``rows`` with every node of more than one leaf split into two."""
    boxes = rows.where("leaves > 1").groupBy("first", "leaves").agg(F.sum("size").alias("bytes"), *_ends(names))
    # The widest dimension, the first of them in a tie.
    shares = [F.struct(((F.col(f"max_{n}") - F.col(f"min_{n}")) / float(ranges[n])).alias("share"), F.lit(-i).alias("minus")) for i, n in enumerate(names)]
    boxes = boxes.withColumn("dim", -F.array_max(F.array(*shares))["minus"])
    low, high = (F.element_at(F.array(*[F.col(f"{end}_{n}") for n in names]), F.col("dim") + 1) for end in ("min", "max"))
    splits = boxes.withColumn("half", F.expr("cast(leaves div 2 as int)")).select(
        "first",
        "half",
        "dim",
        "bytes",
        (F.col("bytes") * F.col("half") / F.col("leaves")).alias("target"),
        low.alias("lo"),
        high.alias("hi"),
        F.lit(0).cast("long").alias("before"),
        # The dimension's value at the median, where that is one value; ties are then cut by their hash.
        F.lit(None).cast("long").alias("value"),
        F.lit(False).alias("done"),
    )
    splits = _narrowed(rows, written(splits, "shards-splits"), "_dim")
    tied = F.col("lo") == F.col("hi")
    reset = {
        "value": F.when(tied, F.col("lo")),
        "lo": F.when(tied, F.lit(-(2**62))).otherwise(F.col("lo")),
        "hi": F.when(tied, F.lit(2**62 - 1)).otherwise(F.col("hi")),
        "done": ~tied,
    }
    splits = splits.select(*[reset.get(c, F.col(c)).alias(c) for c in splits.columns])
    splits = _narrowed(rows, written(splits, "shards-splits"), "tie")
    below_value = (F.col("_dim") < F.col("value")) | ((F.col("_dim") == F.col("value")) & (F.col("tie") < F.col("lo")))
    left = F.when(F.col("value").isNull(), F.col("_dim") < F.col("lo")).otherwise(below_value)
    cut = _met(rows.where("leaves > 1"), splits)
    child = {
        "first": F.when(left, F.col("first")).otherwise(F.col("first") + F.col("half")),
        "leaves": F.when(left, F.col("half")).otherwise(F.col("leaves") - F.col("half")),
    }
    cut = cut.select(*[child.get(c, F.col(c)).alias(c) for c in rows.columns])
    return written(cut.unionByName(rows.where("leaves = 1")), "shards-rows")


def _ends(names: Sequence[str]) -> list[Column]:
    return [f(name).alias(f"{f.__name__}_{name}") for name in names for f in (F.min, F.max)]


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dimensions: Sequence[str] = DIMENSIONS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard (from 0, near equal bytes) and slot.

    ``size`` is the text's UTF-8 bytes plus one, for a null text one; its CRC is that of an empty
    text then. Give the number of ``shards``, or the ``target_bytes`` that no leaf shall exceed by
    more than its last document. Slots count from 0 without gaps within a shard. Null dimensions
    sort first; documents that agree in all of them, ties and repeated rows among them, are split
    by a hash of their row, so a value that many share splits evenly. An empty table gives no
    rows. A shard may be empty if there are fewer documents than shards. Other columns play no
    part, whatever their names.
    """
    names = [f"d_{i}" for i in range(len(dimensions))]
    content = F.coalesce(F.col(text), F.lit(""))
    texts = [alias for name, alias in zip(dimensions, names, strict=True) if dict(docs.dtypes)[name] == "string"]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"),
        *[(F.col(name) if alias in texts else numeric(docs, name)).alias(alias) for name, alias in zip(dimensions, names, strict=True)],
    )
    # Written: row numbers of its files stay as they are from here on.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "shards-rows")
    for name in texts:
        rows = ranked(rows, name)
    tie = F.shiftright(F.xxhash64("doc_id", "text_crc32", "row"), 1)
    rows = written(rows.withColumn("tie", tie), "shards-rows")

    root = rows.agg(F.sum("size").alias("bytes"), *_ends(names)).first()
    total = root["bytes"] or 0
    most = shards or max(1, math.ceil(total / target_bytes))
    ranges = {name: max(1, (root[f"max_{name}"] or 0) - (root[f"min_{name}"] or 0)) for name in names}
    rows = rows.withColumn("first", F.lit(0)).withColumn("leaves", F.lit(most))
    while most > 1 and total:
        rows = _halved(rows, names, ranges)
        most -= most // 2
    # A leaf is its own first; rows are numbered in the order of the first written table.
    placed = rows.withColumn("shard", F.col("first").cast("int")).withColumn("chunk", F.shiftright("row", CHUNK_BITS))
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row")) - 1
    numbered = placed.withColumn("_within", within).join(starts, ["shard", "chunk"])
    slot = (F.col("start") + F.col("_within")).cast("long").alias("slot")
    return numbered.select("doc_id", "size", "text_crc32", "shard", slot)
