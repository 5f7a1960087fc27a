"""Near duplicates by HyperMinHash.

A document is the set of its distinct word shingles. Each shingle's hash chooses one of ``BANDS`` x
``ROWS`` buckets; a bucket keeps the smallest second hash, compressed to its number of leading
zeros and the ten bits after them (16 bits in all). Empty buckets borrow from others by a fixed
probe sequence, so short documents have full sketches too. Bands of ``ROWS`` registers are the
join keys. Two sets of similarity s share no band with probability (1 - s^6)^48, which at 0.8 is
5 in ten million, and less above.

Work grows with the documents, not with the pairs inside a group of copies:

* documents with equal sets form one *class*, by a map-side combined aggregation; everything
  below is between classes, so thousands of copies are one class;
* every class is first paired with one hub, the smallest class that any of its buckets holds. Then,
  in each bucket, one representative of every component is paired with the bucket's hub (a star).
  Pairs pass the size bound, then the estimate of the sketches (corrected for chance collisions of
  registers), then the comparison of the full sets. Stars join groups of near copies into components;
* what shares a bucket but is still in different components is then compared as well, so no link
  that a bucket could show is missed. In buckets of up to ``LARGE`` members these are pairs, at most
  half of ``LARGE`` a member. Of a larger bucket the members outside its main component meet all
  members in blocks: full sets (as 64-bit shingle hashes) are compared inside a task, and only links
  leave it. Pairs within a component are never looked at.

Rows are thus in proportion to the documents. The comparisons of a large bucket are not, where most
of its members lie just below the threshold: they grow with its square, shared out over its blocks.

Components come from min-label propagation with pointer jumps, each round a written table.

No join here has a broadcast side: all tables grow with the documents (``shuffled``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickwork.llm.tables import free_name, releasing, with_python, written

BANDS = 48
ROWS = 6
BUCKETS = BANDS * ROWS
MANTISSA = 10
#: The estimate may be so many standard deviations below the threshold before a pair is dropped.
SLACK = 6.0
#: Buckets with more classes are compared in blocks of about ``BLOCK`` classes and ``BLOCK_BYTES`` bytes.
LARGE = 8
BLOCK = 256
BLOCK_BYTES = 4 << 20
#: Shares that the rows of one component or hub are dealt into before a join by it.
SHARES = 16
#: Distinct shingles of a block compared at a time.
COLUMNS = 16_384

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """Lower case for A-Z only; words end at space and at the control characters 9 to 13."""
    return text.encode().lower().split()


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; all words as one where they are fewer than ``width``."""
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words(text)), np.uint64)
    if not len(hashed):
        return hashed
    width = min(width, len(hashed))
    out = np.zeros(len(hashed) - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out * _STEP + hashed[i : len(hashed) - width + 1 + i] + _STEP)
    return np.unique(out)


#: Where an empty bucket looks, try by try.
_PROBES = (mixed(np.arange(512 * BUCKETS, dtype=np.uint64) + _STEP) % np.uint64(BUCKETS)).astype(np.int64).reshape(512, BUCKETS)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set that is not empty."""
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    value = mixed(hashes + _STEP)
    largest_first = np.argsort(value)[::-1]
    smallest = np.zeros(BUCKETS, np.uint64)
    smallest[bucket[largest_first]] = value[largest_first] | np.uint64(1)
    full = smallest != 0
    # value = 1.mantissa x 2^(63 - zeros)
    fraction, exponent = np.frexp(smallest[full].astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62)
    out = np.zeros(BUCKETS, np.uint16)
    out[full] = ((zeros + 1) << MANTISSA) | np.minimum((fraction * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.int64)
    source = np.where(full, np.arange(BUCKETS), -1)
    for probe in _PROBES:
        empty = np.flatnonzero(source < 0)
        if not len(empty):
            break
        at = probe[empty]
        source[empty[full[at]]] = at[full[at]]
    source[source < 0] = np.flatnonzero(full)[0]
    return out[source]


def estimate(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Similarity of sketches (one per row). Registers of different minima agree by chance where
    they fall into one cell: about 0.72 / 2^MANTISSA of a minimum wide, for sets of n and m members
    n m / (n + m)^2 of that. This share is taken out."""
    chance = 0.72 / (1 << MANTISSA) * (sizes * other) / (sizes + other) ** 2
    return ((left == right).mean(axis=1) - chance) / (1 - chance)


SKETCH = "doc_id {id}, text_hash bigint, n_shingles bigint, set_hash binary, registers binary"


def sketches(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, a hash of the text, the set's size, its 128-bit hash, and the registers."""
    with_python(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("text"))

    @releasing
    def sketch(batches):
        for batch in batches:
            sizes, sets, kept = [], [], []
            for value in batch.column("text").to_pylist():
                hashes = shingle_hashes(value or "", width)
                sizes.append(len(hashes))
                sets.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                kept.append(registers(hashes).tobytes() if len(hashes) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(kept, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "set_hash", "registers"],
            )

    return slim.mapInArrow(sketch, SKETCH.format(id=docs.schema[doc_id].dataType.simpleString()))


def alike(threshold: int):
    """Column function on two sketches and their sizes: may they reach ``threshold`` percent?"""

    @F.arrow_udf(T.BooleanType())
    @releasing
    def may_reach(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, BUCKETS) for x in (a, b))
        sizes, other = (x.to_numpy(zero_copy_only=False).astype(float) for x in (n, m))
        s = threshold / 100
        slack = SLACK * np.sqrt(s * (1 - s) / np.minimum(np.minimum(sizes, other), BUCKETS))
        return pa.array(estimate(left, right, sizes, other) >= s - slack)

    return may_reach


def confirmed(width: int, threshold: int):
    """Column function on two texts: 100 x common shingles >= threshold x all of them."""

    def shingles(text: str) -> set[tuple[bytes, ...]]:
        w = words(text)
        size = min(width, len(w))
        return set(zip(*(w[i : len(w) - size + 1 + i] for i in range(size)), strict=True))

    @F.arrow_udf(T.BooleanType())
    @releasing
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, right = [], None, set()
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if y != last:
                last, right = y, shingles(y)
            left = shingles(x)
            common = len(left & right)
            out.append(100 * common >= threshold * (len(left) + len(right) - common))
        return pa.array(out, pa.bool_())

    return linked


def shuffled(looked_up: DataFrame) -> DataFrame:
    """A side of a join that is not broadcast, however small its files are. Spark goes by their bytes,
    and neither compression nor rows multiplied since count: labels in 200 KB of files are 46 MB in the
    driver, once copied for ``SHARES`` tasks and hashed."""
    return looked_up.hint("merge")


def joined(rows: DataFrame, by: str, looked_up: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with what ``looked_up`` has under ``key`` for their column ``by``. Many rows may look for
    one key: they go to ``SHARES`` tasks, each of which has a copy of the narrow row found."""
    rows = rows.withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.lit(SHARES)))
    copies = looked_up.withColumn("_copy", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SHARES)])))
    return rows.join(shuffled(copies), (rows[by] == copies[key]) & (rows["_share"] == copies["_copy"]), how).drop("_share", "_copy")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (a, b): the smallest node it is connected with."""
    # Both directions from one pass over the links, which may still have to be computed.
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(links.select(F.explode(both).alias("_")).select("_.a", "_.b").distinct(), "dedup-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "dedup-labels")
    while True:
        # The smallest label around, then the label of that label.
        around = joined(edges, "b", labels, "node").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(shuffled(around), labels.node == around.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("near"))
        jumps = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        after = F.coalesce("beyond", "near")
        nearer = joined(lower, "near", jumps, "at", "left").select("node", after.alias("label"), (after != F.col("label")).alias("moved"))
        nearer = written(nearer, "dedup-labels")
        labels = nearer.select("node", "label")
        if nearer.where("moved").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    threshold: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id and ``kept``.

    ``component_id`` is the smallest doc_id that links of ``threshold`` percent or more lead to, itself
    included. ``kept`` marks the rows of one document in each component, that with the smallest
    doc_id. Null and blank texts have an empty set and are linked with nothing; all are kept. Rows
    repeated as they are have one component and are all marked; ``deduplicated`` leaves one of
    them. A null doc_id counts as larger than all others; where a component has no other,
    component_id is null. Extra columns of ``docs`` play no part.
    """
    spark = docs.sparkSession
    rows = written(sketches(docs, width, doc_id, text), "dedup-sketches")
    classes = (
        rows.where("n_shingles > 0")
        .groupBy("set_hash")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("_first"),
            F.first("n_shingles").alias("n"),
            F.first("registers").alias("registers"),
        )
        .select(F.monotonically_increasing_id().alias("node"), "set_hash", "_first", "n", "registers")
    )
    classes = written(classes, "dedup-classes")  # also fixes the node numbers

    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])
    bucketed = classes.select("node", "n", F.explode(keys).alias("key"))
    hubs = bucketed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).where("hub < _last").drop("_last")
    shared = written(bucketed.join(shuffled(hubs), "key"), "dedup-buckets")

    sets = written(_texts(docs, classes, shared, doc_id, text), "dedup-texts")
    sized = classes.select("node", "n", "registers")
    link = _Linker(sets, sized, width, threshold)

    nearest = shared.where("node <> hub").groupBy("node").agg(F.min("hub").alias("first_hub"))
    first = written(link(nearest.select(F.col("node").alias("a"), F.col("first_hub").alias("b"))), "dedup-links")
    placed = written(_placed(shared, components(first)).join(shuffled(nearest), "node", "left"), "dedup-placed")
    hubs = placed.where("node = hub").select("key", F.col("label").alias("hub_label"))
    # Not the pairs looked at already: where these are no links, others of the component may be.
    star = placed.where("node <> hub and hub <> first_hub").join(shuffled(hubs), "key").where("label <> hub_label")
    star = star.groupBy("key", "label", "hub").agg(F.min("node").alias("a")).select("a", F.col("hub").alias("b")).distinct()
    stars = written(first.union(link(star)), "dedup-links")

    placed = _placed(shared, components(stars))
    sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("of_label"), F.sum("n").alias("shingles"))
    sizes = sizes.groupBy("key").agg(
        F.max_by("label", F.struct("of_label", "label")).alias("main"),
        F.max(F.struct("of_label", "label", "shingles")).alias("_main"),
        F.sum("of_label").alias("members"),
        F.sum("shingles").alias("shingles"),
    )
    visitors, theirs = F.col("members") - F.col("_main.of_label"), F.col("shingles") - F.col("_main.shingles")
    sizes = sizes.where(visitors > 0).select("key", "main", "members", _blocks("members", "shingles").alias("m_blocks"), _blocks(visitors, theirs).alias("v_blocks"))
    apart = written(placed.join(shuffled(sizes), "key"), "dedup-apart")

    x, y = (apart.where((F.col("members") <= LARGE) & (F.col("node") != F.col("hub"))).alias(name) for name in "xy")
    close = (F.col("x.n") * threshold <= F.col("y.n") * 100) & (F.col("y.n") * threshold <= F.col("x.n") * 100)
    across = x.join(shuffled(y), (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & close)
    across = across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    # The hub has been compared with one member of each component only.
    hub = apart.where((F.col("members") <= LARGE) & (F.col("node") == F.col("hub"))).select("key", F.col("label").alias("hub_label"))
    to_hub = apart.where((F.col("members") <= LARGE) & (F.col("node") != F.col("hub"))).join(shuffled(hub), "key").where("label <> hub_label")
    pairs = link(across.union(to_hub.select("node", "hub")).distinct())
    blocks = _block_links(apart.where(F.col("members") > LARGE), sets, width, threshold)
    labels = components(stars.union(pairs).union(blocks))

    linked = classes.join(shuffled(labels), "node").select("node", "_first", "label")
    winners = linked.groupBy("label").agg(F.min("_first").alias("_winner"))
    winners = joined(linked.select("node", "label"), "label", winners.withColumnRenamed("label", "_label"), "_label").select("node", "_winner")
    decided = classes.join(shuffled(winners), "node", "left").select("set_hash", F.coalesce("_winner", "_first").alias("_winner"))
    out = rows.drop("registers").join(shuffled(decided), "set_hash", "left")
    alone = F.col("_winner").isNull()
    first = (F.col("_winner.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("_winner.text_hash") == F.col("text_hash"))
    return out.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_winner.doc_id")).alias("component_id"),
        (alone | first).alias("kept"),
    )


def _placed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, node, n, hub, label``: members of buckets with their components."""
    return shared.join(shuffled(labels), "node", "left").select("key", "node", "n", "hub", F.coalesce("label", "node").alias("label"))


def _blocks(members, shingles):
    """Into how many blocks so many members with so many shingles in all are cut."""
    members, shingles = (F.col(x) if isinstance(x, str) else x for x in (members, shingles))
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles * 8 / BLOCK_BYTES)).cast("long")


def _texts(docs: DataFrame, classes: DataFrame, shared: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``node, text`` of the classes that share a bucket with another."""
    wanted = classes.join(shuffled(shared.select("node").distinct()), "node", "left_semi").select("node", F.col("_first.doc_id").alias("_id"), F.col("_first.text_hash").alias("_hash"))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    found = plain.join(shuffled(wanted), (plain.text_hash == wanted._hash) & plain.doc_id.eqNullSafe(wanted._id))
    return found.select("node", "text").dropDuplicates(["node"])


def set_of(width: int):
    """Column function: a text's sorted distinct shingle hashes, as bytes."""

    @F.arrow_udf(T.BinaryType())
    @releasing
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(text.as_py(), width).tobytes() for text in texts], pa.binary())

    return hashes


def common_members(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right; sets are sorted arrays."""
    distinct = np.unique(np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(distinct), COLUMNS):
        part = distinct[start : start + COLUMNS]
        sides = []
        for sets in (left, right):
            has = np.zeros((len(sets), len(part)), np.float32)
            for i, members in enumerate(sets):
                inside = members[np.searchsorted(members, part[0]) : np.searchsorted(members, part[-1], "right")]
                at = np.searchsorted(part, inside)
                has[i, at[part[at] == inside]] = 1
            sides.append(has)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _block_links(rows: DataFrame, sets: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links (a, b) between the members of large buckets that lie in different components.

    ``rows``: key, node, label, main, m_blocks, v_blocks. Visitors, in blocks, meet all members, in
    blocks; of a visitor's links to one component in one block, one is enough. Pairs of blocks, not
    buckets, are dealt to tasks.
    """
    wanted = sets.join(shuffled(rows.select("node").distinct()), "node", "left_semi")
    sets = written(wanted.select("node", set_of(width)("text").alias("set")), "dedup-sets")
    meetings = rows.where("label <> main").select("key", "v_blocks", "m_blocks").distinct()
    for side in "vm":
        meetings = meetings.withColumn(f"{side}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{side}_blocks") - 1)))
    meetings = meetings.drop("v_blocks", "m_blocks")
    rows = rows.join(shuffled(sets), "node")

    def packed(some: DataFrame, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.col(f"{name}_blocks")).alias(f"{name}_block")
        some = some.groupBy("key", block).agg(F.collect_list(F.struct("node", "label", "set")).alias("rows"))
        return shuffled(some.select("key", f"{name}_block", *[F.col(f"rows.{c}").alias(f"{name}_{c}") for c in ("node", "label", "set")]))

    met = meetings.join(packed(rows.where("label <> main"), "v"), ["key", "v_block"]).join(packed(rows, "m"), ["key", "m_block"])

    @releasing
    def links(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                v, v_label, m, m_label = (batch.column(c)[i].values.to_numpy() for c in ("v_node", "v_label", "m_node", "m_label"))
                left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(c)[i].as_py()] for c in ("v_set", "m_set"))
                common = common_members(left, right)
                both = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - common
                at, to = np.nonzero((100 * common >= threshold * both) & (v_label[:, None] != m_label))
                _, first = np.unique(np.stack([at, m_label[to]], axis=1), axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(v[at[first]]), pa.array(m[to[first]])], ["a", "b"])

    return met.drop("key", "v_block", "m_block").mapInArrow(links, "a long, b long")


class _Linker:
    """Candidate pairs (a, b) to links: size bound, estimate, full sets."""

    def __init__(self, sets: DataFrame, sized: DataFrame, width: int, threshold: int):
        self.sets, self.sized, self.width, self.threshold = sets, sized, width, threshold

    def __call__(self, pairs: DataFrame) -> DataFrame:
        def side(frame: DataFrame, end: str) -> DataFrame:
            return shuffled(frame.select(*[F.col(c).alias(end if c == "node" else f"{c}_{end}") for c in frame.columns]))

        t = self.threshold
        pairs = pairs.join(side(self.sized, "a"), "a").join(side(self.sized, "b"), "b")
        pairs = pairs.where((F.col("n_a") * t <= F.col("n_b") * 100) & (F.col("n_b") * t <= F.col("n_a") * 100))
        pairs = pairs.where(alike(t)("registers_a", "registers_b", "n_a", "n_b")).select("a", "b")
        pairs = pairs.join(side(self.sets, "a"), "a").join(side(self.sets, "b"), "b")
        return pairs.where(confirmed(self.width, t)("text_a", "text_b")).select("a", "b")


def deduplicated(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept, one of each component, all columns as they are.

    Rows that repeat doc_id and text are one document, of which any one row stays; only such rows
    are shuffled as a whole. Null and blank texts stay, as does a table without rows.
    """
    verdict = written(near_duplicates(docs, width, threshold), "dedup-verdict")
    named = verdict.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "kept", "n_shingles")
    gone = named.where("not kept").select("_id", "_hash")
    repeated = named.where("kept and n_shingles > 0").groupBy("_id", "_hash").count().where("count > 1").select("_id", "_hash")
    key = free_name(docs, "_text_hash")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))

    def matched(other: DataFrame, how: str) -> DataFrame:
        same = keyed.doc_id.eqNullSafe(other._id) & (keyed[key] == other._hash)
        return keyed.join(other, same, how).select(*docs.columns)

    once = matched(gone.union(repeated), "left_anti")
    return once.unionByName(matched(repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
