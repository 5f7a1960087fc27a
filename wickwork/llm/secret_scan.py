"""Secrets in texts: candidates by shape, false positives removed by a random forest.

Candidates are unbroken strings of key characters with a digit or mixed case, long enough to be a
secret, and whatever is assigned to a secret's name, at any length. A candidate is described by its
length, its character transitions, how much of it is made of pieces of the corpus' own words (the
dictionary), whether it lies in a path or address, and the words beside it, hashed into ``SLOTS``
features. A random forest (Spark's own) learns from labelled findings which are secrets, and scores all.

Where no labelled findings are given, candidates label themselves on a documented rule
(:func:`self_labels`): a format that issuers guarantee, or an assignment to a secret's name, is a
finding; words, card numbers, addresses and the like are false positives, and so is a plain word after
a name and a colon ("password: required"); the rest has no label. The forest sees neither prefix nor
format. ``hidden`` names features that it shall not see either: without ``RULE``, all that tells of an
assignment, it has to generalise from length, transitions, dictionary and surroundings.

One in ``KEPT_BACK`` labelled values, by hash, is never learnt from (``held_out``), so its findings
tell precision and recall; all findings of a value are on one side.

The dictionary is bounded: the ``WORDS`` most frequent words, by counts over all texts. At most
``SAMPLE`` findings per label are learnt from, those with the smallest hashes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickwork.llm.tables import with_python, written

WORDS = 20_000
SAMPLE = 20_000
TREES, DEPTH, SEED = 40, 8, 7
THRESHOLD = 0.5
#: One in so many labelled values is not learnt from.
KEPT_BACK = 5
#: Features that neighbouring words are hashed into.
SLOTS = 32
#: Letters of the longest word the dictionary may hold.
LETTERS = 40
#: Characters looked at on each side of a candidate.
BESIDE = 40

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{12,}")
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "auth", "bearer")
#: Fixed formats of issued keys.
FORMATS = (r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"sk_live_[A-Za-z0-9]{16,}", r"AIza[A-Za-z0-9_-]{35}")
_FORMAT = re.compile("|".join(f"(?:{f})" for f in FORMATS))
_ASSIGN = r"(?::=|=>|==?|:)"
_NAMED = re.compile(rf"(?:{'|'.join(SECRET_NAMES)})[\"']?\s*{_ASSIGN}\s*[\"']?$", re.IGNORECASE)
#: A secret's name and the value assigned to it on the same line: between quotes, else up to a space or separator.
_ASSIGNED = re.compile(
    rf"(?:{'|'.join(SECRET_NAMES)})[\"']?[ \t]*{_ASSIGN}[ \t]*(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|[\"']?([^\s\"'`,;&<>]+))", re.IGNORECASE
)
#: What is left of a name before an assigned value.
_NAME_PART = re.compile(r"[A-Za-z0-9_.-]*\Z")
#: A colon that assigns nothing for certain: no quotes, no ``:=``.
_COLON = re.compile(r"[A-Za-z_]\s*:\s*$")
_NAME_NEAR = re.compile("|".join(SECRET_NAMES), re.IGNORECASE)
_RUN = re.compile("[a-z]{2,}")

FEATURES = (
    "length", "digits", "upper", "lower", "signs", "distinct", "turns", "repeats", "longest_run", "entropy", "hexadecimal",
    "dictionary", "in_path", "assigned", "quoted", "name_near", "words_beside",
    *(f"beside_{i}" for i in range(SLOTS)),
)
#: What the self-labelling rule goes by.
RULE = ("assigned", "quoted", "name_near")
_FINDING = T.ArrayType(
    T.StructType()
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
    .add("value", T.StringType())
    .add("label", T.IntegerType())
    .add("features", T.ArrayType(T.DoubleType()))
)
_ARROW = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))])
)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def _assigned(text: str) -> list[tuple[int, int, int]]:
    """(where the name starts, start, end) of values assigned to a secret's name; padding is part of a value."""
    out = []
    for m in _ASSIGNED.finditer(text):
        group = m.lastindex
        start, end = m.span(group)
        while group == 3 and end > start and text[end - 1] in ".:)]}":
            end -= 1
        if text[start:end].strip():
            out.append((m.start(), start, end))
    return out


def _shaped(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The part of a run of key characters that could be a secret."""
    # ``name=value`` is one run of key characters; the value is what counts, padding at its end aside.
    while end > start and text[end - 1] in ".-_/=":
        end -= 1
    cut = text.rfind("=", start, max(start, end - 8))
    if cut > start:
        start = cut + 1
    value = text[start:end]
    if end - start >= 12 and (any(c.isdigit() for c in value) or not (value.islower() or value.isupper() or value.istitle())):
        return [(start, end)]
    return []


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of strings that could be secrets."""
    named = _assigned(text)
    out = {(start, end) for _, start, end in named}
    at = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(named) and named[at][2] <= start:
            at += 1
        k = at
        while k < len(named) and named[k][0] < end:
            name, first, last = named[k]
            if first <= start and end <= last and (start, end) != (first, last):
                break  # inside a longer value: a candidate beside it
            if name > start:
                out.update(_shaped(text, start, start + _NAME_PART.search(text[start:name]).start()))
            start = max(start, min(last, end))
            k += 1
        out.update(_shaped(text, start, end))
    return sorted(out)


def _made_of_words(run: str, words: frozenset[str]) -> bool:
    """Is a run of lower-case letters a word, or two of them?"""
    n = len(run)
    if n > 2 * LETTERS:
        return False
    return run in words or any(run[:k] in words and run[k:] in words for k in range(max(2, n - LETTERS), min(LETTERS, n - 2) + 1))


def _beside(before: str, after: str) -> list[float]:
    """Which slots the neighbouring words fall into; names of secrets have a feature of their own."""
    slots = [0.0] * SLOTS
    for word in _RUN.findall(before.lower()) + _RUN.findall(after.lower()):
        if word not in SECRET_NAMES:
            slots[zlib.crc32(word.encode()) % SLOTS] = 1.0
    return slots


def describe(text: str, start: int, end: int, words: frozenset[str]) -> list[float]:
    """The features of a candidate, in the order of ``FEATURES``."""
    value = text[start:end]
    n = len(value)
    kinds = [_kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (n - 1 or 1)
    repeats = sum(a == b for a, b in zip(value, value[1:], strict=False)) / (n - 1 or 1)
    run = longest = 1
    for a, b in zip(kinds, kinds[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    counts = np.unique(list(value), return_counts=True)[1] / n
    covered = sum(len(r) for r in _RUN.findall(value.lower()) if _made_of_words(r, words))
    before, after = text[max(0, start - BESIDE) : start], text[end : end + BESIDE]
    tail = before.rstrip("\"' ")
    return [
        float(n), share[0], share[1], share[2], share[3], len(counts) / n, turns, repeats, float(longest),
        float(-(counts * np.log2(counts)).sum()), float(all(c in "0123456789abcdefABCDEF" for c in value)), covered / n,
        float(before[-1:] in ("/", "\\", "@") or after[:1] in ("/", "@") or value.count("/") > 1 or "://" in before[-12:]),
        float(tail[-1:] in ("=", ":")), float(before[-1:] in ("'", '"')), float(bool(_NAME_NEAR.search(before))),
        float(len(_RUN.findall(before)) + len(_RUN.findall(after))),
        *_beside(before, after),
    ]


def self_label(text: str, start: int, end: int) -> int | None:
    """1 for a guaranteed format or an assignment to a secret's name, 0 for words, numbers and addresses."""
    value = text[start:end]
    if _FORMAT.fullmatch(value):
        return 1
    before = text[max(0, start - BESIDE) : start]
    if _NAMED.search(before):
        # A colon and a plain word are prose as well as an assignment.
        return 0 if _COLON.search(before) and value.isalpha() and (value.islower() or value.istitle()) else 1
    if value.replace("-", "").replace(".", "").isdigit() or value.replace("-", "").replace("_", "").isalpha() or text[end : end + 1] == "@":
        return 0
    if value.count("/") > 1 or re.fullmatch(r"[A-Za-z]+([._-][A-Za-z]+)+[0-9]{0,4}", value):
        return 0
    return None


def dictionary(docs: DataFrame, text: str = "text", size: int = WORDS) -> DataFrame:
    """The ``size`` most frequent lower-case words of 2 to ``LETTERS`` letters, ties by the word; counts over all texts.

    A longer run of letters is no word, and none of its pieces counts as one.
    """
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{2,}"), 0)).alias("word")
    return docs.select(words).where(F.length("word") <= LETTERS).groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).select("word")


def find(docs: DataFrame, words: frozenset[str], text: str = "text", spans: str | None = None) -> DataFrame:
    """One row per candidate: the columns of ``docs`` but the text, and start, end, value, label, features.

    With ``spans``, a column of (start, end) lists, one row per span of the text that is no candidate instead.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def described(value: str, places: list[tuple[int, int]]) -> list[dict]:
        return [
            {"start": s, "end": e, "value": value[s:e], "label": self_label(value, s, e), "features": describe(value, s, e, shared.value)}
            for s, e in places
        ]

    @F.arrow_udf(_FINDING)
    def findings(column: pa.Array) -> pa.Array:
        texts = (v.as_py() or "" for v in column)
        return pa.array([described(value, candidates(value)) for value in texts], _ARROW)

    @F.arrow_udf(_FINDING)
    def others(column: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for v, listed in zip(column, places, strict=True):
            value = v.as_py() or ""
            known = set(candidates(value))
            wanted = sorted({(p["start"], p["end"]) for p in listed.as_py() or []} - known)
            out.append(described(value, [(s, e) for s, e in wanted if 0 <= s < e <= len(value)]))
        return pa.array(out, _ARROW)

    found = findings(F.col(text)) if spans is None else others(F.col(text), F.col(spans))
    return docs.select(*[c for c in docs.columns if c not in (text, spans)], F.explode(found).alias("_f"))


def secrets(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    hidden: Sequence[str] = (),
) -> DataFrame:
    """One row per candidate or judged finding: doc_id, start, end, value, label, held_out, probability and is_secret.

    ``held_out`` findings have a label that was not learnt from. The forest does not see the features
    named in ``hidden``.

    ``labelled`` (doc_id, start, end, label) are findings that people judged; without it candidates
    label themselves. Spans are code points, end exclusive. Null and empty texts have no candidates;
    repeated rows repeat theirs; findings with a null label, id or place, or one outside the text, are not learnt from. If labels of
    only one kind, or none, are there, nothing can be learnt, and the label, else null, is the
    answer. Extra columns of ``docs`` play no part.
    """
    spark = with_python(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Written first, so that the parts' most frequent words meet in a task and only WORDS reach the driver.
    words = frozenset(r["word"] for r in written(dictionary(slim), "secret-words").collect())
    rows = find(slim, words).select("doc_id", "_f.*")
    if labelled is not None:
        place = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
        spans = labelled.where("doc_id is not null and label is not null and start is not null and end is not null")
        spans = spans.groupBy("doc_id").agg(F.collect_set(place).alias("_spans"))
        rows = rows.unionByName(find(slim.join(spans, "doc_id"), words, spans="_spans").select("doc_id", "_f.*"))
    rows = written(rows, "secret-findings")
    if labelled is not None:
        judged = labelled.select("doc_id", "start", "end", F.col("label").alias("_judged")).where("label is not null")
        judged = judged.groupBy("doc_id", "start", "end").agg(F.max("_judged").cast("int").alias("label"))
        rows = rows.drop("label").join(judged, ["doc_id", "start", "end"], "left").select(*rows.columns)
    seen = F.array(*[F.col("features")[i] for i, name in enumerate(FEATURES) if name not in hidden])
    rows = rows.withColumn("_vector", array_to_vector(seen))
    apart = F.pmod(F.xxhash64("value", F.lit(SEED)), F.lit(KEPT_BACK)) == 0
    rows = rows.withColumn("held_out", F.col("label").isNotNull() & apart)
    order = F.xxhash64("doc_id", "start", "end", "value")
    parts = [rows.where((F.col("label") == label) & ~F.col("held_out")).orderBy(order, "doc_id", "start", "end").limit(SAMPLE) for label in (0, 1)]
    learnt = written(parts[0].unionByName(parts[1]).select("label", "_vector"), "secret-sample")
    if learnt.select("label").distinct().count() < 2:
        answer = rows.withColumn("probability", F.col("label").cast("double"))
    else:
        forest = RandomForestClassifier(
            featuresCol="_vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=2, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction"
        )
        # One partition of a bounded sample: the same trees whatever the cluster.
        model = forest.fit(learnt.coalesce(1))
        answer = model.transform(rows).withColumn("probability", vector_to_array("_probability")[1])
    return answer.select("doc_id", "start", "end", "value", "label", "held_out", "probability", (F.col("probability") >= threshold).alias("is_secret"))
