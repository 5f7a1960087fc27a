"""Token counts by a two-tier table of pre-token lengths, without shuffling pre-tokens.

A byte-level BPE encodes every pre-token alone, so a text has as many tokens as its pre-tokens have
together, and the length of a pre-token has to be found once only:

* *tier one*, the same in all tasks: the lengths of the ``frequent`` most frequent pre-tokens of all
  texts, packed into a few hundred kilobytes and broadcast. Every task counts its own pre-tokens and
  hands on a summary of at most ``PER_TASK`` of them; only these summaries are added up;
* *tier two*, each worker's own: pre-tokens that are not there are encoded by the tokenizer itself,
  and kept in a cache that is emptied when full.

Neither tier can change a count: what is in them was encoded by the tokenizer.
"""

from __future__ import annotations

import heapq
import json
import os
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from wickwork.llm.byte_bpe import groups, latin_pattern
from wickwork.llm.tables import adding, with_python

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens in the broadcast table. With ``KEPT_CHARS`` this bounds it: 5 MB at most.
FREQUENT = 32_768
#: Pre-tokens in the summary of one task, and those it counts before it drops the rarest half.
PER_TASK, COUNTED = 8_192, 262_144
#: Pre-tokens in a worker's own cache.
CACHED = 131_072
#: Longer pre-tokens (a text without a space) are in neither tier.
KEPT_CHARS = 40
LIMIT = 512


def _resolved(vocabulary: str) -> str:
    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


class Cutter:
    """Pre-tokens of a text as the tokenizer cuts them, and their lengths."""

    def __init__(self, path: str, pattern: str):
        # Spark runs one worker per core; more threads in each would only compete.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        cut = parts["pre_tokenizer"] or {}
        if parts["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        if any(token[flag] for token in parts["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has special tokens that take in what is around them")
        # Special strings inside a text are one token each; the longest one counts.
        special = sorted((token["content"] for token in parts["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.tokenizer = Tokenizer.from_file(path)
        self.pre = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.any = regex.compile(pattern)
        self.latin = latin_pattern(pattern).findall
        self.agreed: dict[str, bool] = {}

    def _agrees(self, char: str) -> bool:
        """Whether both take the character for the same kind; their tables of Unicode may differ in age."""
        known = self.agreed.get(char)
        if known is None:
            probe = f"a{char} 1{char} !{char} {char}x"
            known = self.agreed[char] = [span for _, span in self.pre(probe)] == [m.span() for m in self.any.finditer(probe)]
        return known

    def _cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if all(map(self._agrees, set(text))):
                return self.any.findall(text)
            return [text[a:b] for _, (a, b) in self.pre(text)]
        return self.latin(text)

    def cut(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and the number of special strings between them."""
        if self.special is None or not self.special.search(text):
            return self._cut(text), 0
        pieces = self.special.split(text)
        return [word for piece in pieces for word in self._cut(piece)], len(pieces) - 1

    def lengths(self, words: list[str]) -> list[int]:
        return list(map(len, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)))


@lru_cache(maxsize=2)
def cutter(path: str, pattern: str) -> Cutter:
    return Cutter(path, pattern)


def pack(lengths: dict[str, int]) -> tuple[bytes, bytes, bytes]:
    """The table as three flat buffers: all words joined, their characters, their token counts."""
    words = list(lengths)
    return "".join(words).encode(), bytes(map(len, words)), array("H", lengths.values()).tobytes()


def unpack(table: tuple[bytes, bytes, bytes]) -> dict[str, int]:
    text, out, at = table[0].decode(), {}, 0
    for chars, tokens in zip(table[1], memoryview(table[2]).cast("H"), strict=True):
        out[text[at : at + chars]] = tokens
        at += chars
    return out


class Counts:
    """The two tiers in one process: the broadcast table, and what was encoded beside it."""

    def __init__(self, own: Cutter, table: tuple[bytes, bytes, bytes]):
        self.own = own
        self.frequent = unpack(table)
        self.known = dict(self.frequent)

    def count(self, texts: list[str]) -> list[int]:
        cuts = [self.own.cut(text) for text in texts]
        new = list(set().union(*(words for words, _ in cuts)).difference(self.known))
        if len(self.known) + len(new) > len(self.frequent) + CACHED:
            self.known = dict(self.frequent)
            new = list(set().union(*(words for words, _ in cuts)).difference(self.known))
        self.known.update(zip(new, self.own.lengths(new), strict=True))
        length = self.known.__getitem__
        counts = [sum(map(length, words)) + special for words, special in cuts]
        for word in new:
            if len(word) > KEPT_CHARS:
                del self.known[word]
        return counts


@lru_cache(maxsize=1)
def counts(path: str, pattern: str, table: tuple[bytes, bytes, bytes]) -> Counts:
    return Counts(cutter(path, pattern), table)


SUMMARY = T.StructType().add("word", T.StringType()).add("n", T.LongType())


def frequent_words(texts: DataFrame, entries: int = FREQUENT, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``word``, ``n``: about the ``entries`` most frequent pre-tokens of the first column, over all rows.

    ``n`` may miss what a task dropped as rare, so the list is a good choice, not an exact one. The
    exchange carries at most ``PER_TASK`` rows of each task, however long the texts are.
    """
    with_python(texts.sparkSession)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = cutter(_resolved(vocabulary), pattern), Counter()
        for batch in batches:
            for group in groups(batch.column(0)):
                for text in group:
                    seen.update(own.cut(text)[0])
                if len(seen) > COUNTED:
                    seen = Counter(dict(heapq.nlargest(COUNTED // 2, seen.items(), key=lambda item: item[1])))
        short = (item for item in seen.items() if len(item[0]) <= KEPT_CHARS)
        top = heapq.nlargest(PER_TASK, short, key=lambda item: (item[1], item[0]))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    partial = texts.select(texts.columns[0]).mapInArrow(tally, SUMMARY)
    return partial.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries)


def frequent_lengths(
    texts: DataFrame, entries: int = FREQUENT, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN
) -> tuple[bytes, bytes, bytes]:
    """The packed table of :func:`frequent_words`: at most ``entries`` words of ``KEPT_CHARS`` characters."""
    words = [row["word"] for row in frequent_words(texts, entries, vocabulary, pattern).collect()]
    return pack(dict(zip(words, cutter(_resolved(vocabulary), pattern).lengths(words), strict=True)))


def counter(table: Broadcast, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
    """A column function: text -> number of tokens. A null text has none."""

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        own = counts(_resolved(vocabulary), pattern, table.value)
        return pa.array([n for group in groups(texts) for n in own.count(group)], pa.int64())

    return count


def token_counts(
    docs: DataFrame,
    text: str = "text",
    vocabulary: str = VOCABULARY,
    limit: int = LIMIT,
    frequent: int = FREQUENT,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """All columns, and ``n_bytes`` (UTF-8), ``n_tokens`` (both long), ``over_limit`` (more than ``limit`` tokens).

    Whole texts are counted as the tokenizer counts them without added special tokens: a special
    string inside a text is one token. A null or empty text has no bytes and no tokens. Rows are
    independent, so ties, repeated rows and an empty table need no rule; columns called like the new
    ones are kept as ``<name>_in``. ``vocabulary`` is a name of the public tokenizers or a path that
    the driver and every executor have; ``pattern`` must be the cut of that tokenizer.
    """
    spark = with_python(docs.sparkSession)
    table = spark.sparkContext.broadcast(frequent_lengths(docs.select(text), frequent, vocabulary, pattern))
    names = [name for name in docs.columns if name != text]
    docs = adding(docs.select(text, *names), "n_bytes", "n_tokens", "over_limit")
    own = F.col(f"`{docs.columns[0]}`")
    counted = docs.withColumn("n_bytes", F.coalesce(F.octet_length(own), F.lit(0)).cast("long"))
    counted = counted.withColumn("n_tokens", counter(table, vocabulary, pattern)(own))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
