"""Text quality as perplexity under an interpolated modified Kneser-Ney model of characters.

The model counts character 5-grams of trusted text (labelled good). Tasks count their own texts
and hand in one row per distinct n-gram; sums, continuation counts, discounts and interpolation
weights are joins and aggregations of count tables sharded by n-gram. The n-grams of all documents
to be scored are gathered in the same way, distinct ones only, and get their probabilities by joins
with the tables of every order. Only then texts are scored, by looking n-grams up.

A fifth of the trusted documents is kept out of the counts. Their perplexities set a threshold for each
language: a quantile, drawn towards that of all languages the more the fewer documents it is from,
times a margin, with an allowance for very short texts. Documents above it are rejected.

Characters are 12-bit codes: code points below 3071 have their own, others share 1024. An n-gram is
one 64-bit number, its last character lowest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickwork.llm.tables import free_name, releasing, with_python, written

ORDER = 5
BITS = 12
OWN = 3071
QUANTILE = 0.95
MARGIN = 1.25
#: The first characters of a text are hard to predict: a text of n characters may have a total of
#: so much more negative log probability.
OPENING = 4.0
#: The quantile of all languages weighs as much as so many calibration documents of a language.
PRIOR = 10
#: Characters worked on together in a task, and n-grams it holds before handing them in.
GROUP_CHARS = 500_000
HELD_GRAMS = 3_000_000
#: Probability tables up to this many n-grams (12 bytes each) are broadcast for the look-up; larger
#: ones are joined chunk by chunk.
BROADCAST_GRAMS = 4_000_000
BROADCAST_IDS = 2_000_000
#: Documents whose n-grams are looked up together, where tables are joined.
CHUNK_BITS = 11


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each character of the texts, and where each text ends."""
    lead = ORDER - 1
    ends = np.cumsum([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(codes < OWN, codes + 1, OWN + 1 + codes % ((1 << BITS) - OWN - 1))
    # Code 0 stands before each text's start.
    at = np.arange(len(codes)) - np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)) if len(codes) else codes
    out = codes.copy()
    for back in range(1, lead + 1):
        earlier = np.concatenate([np.zeros(min(back, len(codes)), np.int64), codes[:-back]])
        out += np.where(at >= back, earlier, 0) << (BITS * back)
    return out, ends


def _groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in held])
    at, distinct = pd.factorize(keys)
    return distinct, np.bincount(at, np.concatenate([c for _, c in held]), len(distinct)).astype(np.int64)


@releasing
def _counted(batches):
    """(gram, count) of the task's texts; in several parts if there are very many distinct ones."""
    held, size = [], 0
    for batch in batches:
        for texts in _groups(v.as_py() for v in batch.column(0)):
            at, distinct = pd.factorize(grams(texts)[0])
            held.append((distinct, np.bincount(at, minlength=len(distinct)).astype(np.int64)))
            size += len(distinct)
            if size > HELD_GRAMS:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD_GRAMS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["gram", "count"])
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(held)], ["gram", "count"])


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, count) over the only column of ``texts``."""
    counted = texts.mapInArrow(_counted, "gram long, count long")
    return counted.groupBy("gram").agg(F.sum("count").alias("count"))


def _context(gram: str = "gram") -> Column:
    return F.shiftrightunsigned(F.col(gram), BITS)


def _suffix(order: int, gram: str = "gram") -> Column:
    """The last ``order`` characters."""
    return F.col(gram).bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of n-grams seen once, twice, and more often, from the numbers of n-grams seen 1 to 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratios = (n2 / n1 if n1 else 0.5, n3 / n2 if n2 else 0.5, n4 / n3 if n3 else 0.5)
    raw = [i + 1 - (i + 2) * y * ratios[i] for i in range(3)]
    return tuple(min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw))


class Model:
    """Per order: probabilities of seen n-grams, and the weight that each context gives the next lower order."""

    def __init__(self, counts: DataFrame):
        self.seen: list[DataFrame] = []
        self.weights: list[DataFrame] = []
        tables = {ORDER: written(counts, "lm-counts")}
        for order in range(ORDER - 1, 0, -1):
            kinds = tables[order + 1].groupBy(_suffix(order).alias("gram")).agg(F.count(F.lit(1)).alias("count"))
            tables[order] = written(kinds, "lm-counts")
        lower = None
        for order in range(1, ORDER + 1):
            table = tables[order]
            few = table.agg(*[F.count_if(F.col("count") == i) for i in range(1, 5)]).first()
            d = discounts(*few)
            discount = F.when(F.col("count") == 1, d[0]).when(F.col("count") == 2, d[1]).otherwise(d[2])
            contexts = table.groupBy(_context().alias("context")).agg(
                F.sum("count").alias("total"), (F.sum(discount) / F.sum("count")).alias("weight")
            )
            contexts = written(contexts, "lm-contexts")
            mine = table.select("gram", _context().alias("context"), (F.col("count") - discount).alias("rest"))
            mine = mine.join(contexts, "context").withColumn("_suffix", _suffix(order - 1))
            if lower is None:
                below = F.lit(1.0 / (1 << BITS))
            else:
                mine = mine.join(lower.select(F.col("gram").alias("_suffix"), F.col("p").alias("below")), "_suffix")
                below = F.col("below")
            p = F.col("rest") / F.col("total") + F.col("weight") * below
            lower = written(mine.select("gram", p.alias("p")), "lm-seen")
            self.seen.append(lower)
            self.weights.append(contexts.select("context", "weight"))

    def log_probabilities(self, wanted: DataFrame) -> DataFrame:
        """(gram, logp) for the distinct 5-grams of ``wanted``, by joins with the tables of each order."""
        out = wanted.select("gram").withColumn("_p", F.lit(1.0 / (1 << BITS)))
        for order in range(1, ORDER + 1):
            key = _suffix(order) if order < ORDER else F.col("gram")
            out = out.withColumn("_key", key).withColumn("_of", _context("_key"))
            seen = self.seen[order - 1].select(F.col("gram").alias("_key"), F.col("p").alias("_seen"))
            weight = self.weights[order - 1].select(F.col("context").alias("_of"), F.col("weight").alias("_weight"))
            out = out.join(seen, "_key", "left").join(weight, "_of", "left")
            p = F.coalesce("_seen", F.coalesce("_weight", F.lit(1.0)) * F.col("_p"))
            out = out.select("gram", p.alias("_p"))
        return out.select("gram", F.log("_p").cast("float").alias("logp"))


def perplexities(texts: list[str], keys: np.ndarray, logp: np.ndarray) -> list[float | None]:
    """exp of the mean negative log probability per character, null for an empty text."""
    found, ends = grams(texts)
    at, distinct = pd.factorize(found)
    place = np.searchsorted(keys, distinct)
    if len(distinct) and (len(keys) == 0 or not np.array_equal(keys[np.minimum(place, len(keys) - 1)], distinct)):
        raise RuntimeError("a text has an n-gram that was not gathered: its partitions changed between passes")
    sums = np.concatenate([[0.0], np.cumsum(logp[place].astype(float)[at])]) if len(found) else np.zeros(1)
    starts = np.concatenate([[0], ends[:-1]]).astype(int)
    lengths = ends - starts
    mean = (sums[ends.astype(int)] - sums[starts]) / np.maximum(lengths, 1)
    return [float(np.exp(-m)) if n else None for m, n in zip(mean, lengths, strict=True)]


@releasing
def _chunked(batches):
    """(chunk, gram): the distinct n-grams of each chunk."""
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        for chunk in pd.unique(chunks):
            rows = batch.column("text").filter(pa.array(chunks == chunk))
            for texts in _groups(v.as_py() for v in rows):
                distinct = pd.unique(grams(texts)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), chunk)), pa.array(distinct)], ["chunk", "gram"])


def scorer(docs: DataFrame, model: Model, text: str = "text", name: str = "perplexity") -> Callable[[DataFrame], DataFrame]:
    """A function that adds the texts' perplexity as ``name`` to ``docs``, or to some of its rows."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    table = written(model.log_probabilities(gram_counts(texts)), "lm-scores")
    if table.count() <= BROADCAST_GRAMS:
        rows = table.orderBy("gram").toArrow()
        keys, logp = (rows.column(c).to_numpy() for c in ("gram", "logp"))
        shared = spark.sparkContext.broadcast((keys, logp))

        @F.arrow_udf(T.DoubleType())
        @releasing
        def score(column: pa.Array) -> pa.Array:
            return pa.array([p for group in _groups(v.as_py() for v in column) for p in perplexities(group, *shared.value)], pa.float64())

        return lambda some: some.withColumn(name, score(text))

    chunk = free_name(docs, "_chunk")

    @releasing
    def looked_up(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("gram")
        keys, logp = (theirs.column(c).to_numpy() for c in ("gram", "logp"))
        values = [p for group in _groups(v.as_py() for v in mine.column(text)) for p in perplexities(group, keys, logp)]
        return mine.drop_columns([chunk]).append_column(name, pa.array(values, pa.float64()))

    def look_up(mine: pa.Table, theirs: pa.Table) -> pa.Table:  # Spark counts the arguments
        return looked_up(mine, theirs)

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def by_chunk(some: DataFrame) -> DataFrame:
        numbered = some.withColumn(chunk, F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS))
        gathered = numbered.select(F.col(chunk).alias("chunk"), F.col(text).alias("text"))
        gathered = gathered.mapInArrow(_chunked, "chunk long, gram long").distinct()
        known = gathered.join(table, "gram").select(F.col("chunk").alias("_of"), "gram", "logp")
        return numbered.groupBy(chunk).cogroup(known.groupBy("_of")).applyInArrow(look_up, schema)

    return by_chunk


def quality(
    docs: DataFrame,
    trusted: DataFrame,
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """All columns of ``docs``, and perplexity, threshold and kept (clashing names: see below).

    ``trusted`` names trusted documents by ``doc_id`` (nulls and repetitions do not matter). A fifth
    of them, by a hash of the id, calibrates the thresholds; the others are counted, repeated
    rows as often as they are there. A null or empty text has no perplexity and is kept. Without
    trusted documents all are kept. Every language with calibration documents, null among them, has a
    threshold of its own at every size, a mean (of logarithms) of its quantile and that of all
    languages by number of documents; only languages without any take that of all. ``docs`` is read several times and should be a
    table. New columns whose names are taken get underscores appended.
    """
    with_python(docs.sparkSession)
    ids = written(trusted.select(F.col(doc_id).alias("_id")).where("_id is not null").distinct(), "lm-trusted")
    few = ids.count() <= BROADCAST_IDS
    aside = F.pmod(F.xxhash64("_id"), F.lit(5)) == 0

    def of(part: DataFrame) -> DataFrame:
        part = F.broadcast(part) if few else part
        return docs.join(part, docs[doc_id] == part._id, "left_semi")

    model = Model(gram_counts(of(ids.where(~aside)).select(F.col(text))))
    name = free_name(docs, "perplexity")
    score = scorer(docs, model, text, name)
    out = score(docs)
    calibrated = written(score(of(ids.where(aside))).select(F.col(lang).alias("_lang"), F.col(name).alias("_p")).where("_p is not null"), "lm-calibration")
    cut = F.percentile_approx("_p", F.lit(quantile), F.lit(10_000)) * margin
    overall = calibrated.agg(cut.alias("_all")).first()["_all"]
    weight = F.col("_n") / (F.col("_n") + PRIOR)
    by_lang = calibrated.groupBy("_lang").agg(cut.alias("_cut"), F.count(F.lit(1)).alias("_n"))
    own = F.exp(weight * F.log("_cut") + (1 - weight) * F.log(F.lit(overall).cast("double")))
    of_lang, own_limit = free_name(docs, "_lang"), free_name(docs, "_own")
    by_lang = by_lang.select(F.col("_lang").alias(of_lang), own.alias(own_limit))
    limit, kept = free_name(docs, "threshold"), free_name(docs, "kept")
    joined = out.join(by_lang, out[lang].eqNullSafe(by_lang[of_lang]), "left")
    opening = F.exp(OPENING / F.greatest(F.length(text), F.lit(1)))
    joined = joined.withColumn(limit, F.coalesce(own_limit, F.lit(overall).cast("double")) * opening).drop(own_limit, of_lang)
    return joined.withColumn(kept, F.coalesce(F.col(name) <= F.col(limit), F.lit(True)))
