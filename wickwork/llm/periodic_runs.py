"""Runs of words that repeat with a period, found by recursive frequency splitting.

A run of length L and smallest period q, L >= max(6, 4 q), has each of its words at least four
times, and each word of a run of one word six times. So a word that occurs less than four times in
a segment cannot be in a run within that segment, and splits it; the parts are shorter, so further
words become rare in them. That goes on until no segment changes, for all texts of a batch at once.

The segments left are scanned by lag. A run of period q and length 4 q or more holds four
multiples of q, all with the same word; for each lag these multiples are compared, some m / q of a
segment of m words, and only where four agree is the stretch of words equal to those q later
measured. All lags together take about m log m steps, also in a segment of one long run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickwork.llm.tables import adding, free_name, with_python

#: A run has at least so many words, and so many periods. Rarer words than that split a segment.
WORDS, PERIODS = 6, 4
#: Bytes of text whose words are split together.
GROUP_BYTES = 1_000_000
#: Words compared at a time when a run is measured; doubled as it goes on.
STRIDE = 64

PARTS = ("start", "length", "period")
Run = tuple[int, int, int]


def segments(ids: np.ndarray, texts: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of words that no rare word splits any more, as places in ``ids``, end exclusive.

    ``texts`` holds the number of the text of each word, not falling; a segment is within one text.
    """
    at = np.arange(len(ids))
    part = texts
    while len(at):
        # The words left, each counted within its segment.
        key = part * np.int64(ids.max() + 1) + ids[at]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        common = count[inverse] >= PERIODS
        at, old = at[common], part[common]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (np.diff(old) != 0)
        part = np.cumsum(fresh) - 1
        size = np.bincount(part) if len(part) else part
        long = size[part] >= WORDS
        if common.all() and long.all():
            break
        at, part = at[long], part[long]
    if not len(at):
        return []
    starts = at[np.flatnonzero(np.r_[True, np.diff(part) != 0])]
    sizes = np.unique(part, return_counts=True)[1]
    return [(int(a), int(a + n)) for a, n in zip(starts, sizes, strict=True)]


def _equal_until(a: np.ndarray, i: int, lag: int, step: int) -> int:
    """The first place from ``i`` on, going by ``step``, whose word is not the one ``lag`` later."""
    width, end = STRIDE, len(a) - lag if step > 0 else -1
    while i != end:
        stop = min(i + width, end) if step > 0 else max(i - width, end)
        low, high = (i, stop) if step > 0 else (stop + 1, i + 1)
        differ = np.flatnonzero(a[low:high] != a[low + lag : high + lag])
        if len(differ):
            return low + int(differ[0] if step > 0 else differ[-1])
        i, width = stop, width * 2
    return end


def runs_in(a: np.ndarray) -> list[Run]:
    """All runs (start, length, smallest period) of one segment."""
    m, found = len(a), []
    starts = reach = np.empty(0, np.int64)
    for q in range(1, m // PERIODS + 1):
        # Multiples of q: four in a row with one word.
        s = a[::q]
        same = s[1:] == s[:-1]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
        # Four within a run that is known: its period divides q, or q is no period here.
        if len(starts) and len(hits):
            earlier = np.searchsorted(starts, hits, "right")
            hits = hits[(earlier == 0) | (reach[earlier - 1] <= hits + 3 * q)]
        # Between the first and the last of the four, words q apart are the same.
        for by in range(1, min(2 * q, STRIDE)):
            if not len(hits):
                break
            hits = hits[a[hits + by] == a[hits + by + q]]
        known, until = len(found), 0
        for p in hits.tolist():
            if p + 3 * q < until:
                continue
            begin = _equal_until(a, p, q, -1) + 1
            end = _equal_until(a, p, q, 1)
            # A stretch that ends before the four do is another run's, or none.
            if end > p + 2 * q and end - begin + q >= max(WORDS, PERIODS * q):
                found.append((begin, end - begin + q, q))
                until = end + q
        if len(found) > known:
            order = sorted(found)
            starts = np.array([start for start, _, _ in order])
            reach = np.maximum.accumulate([start + length for start, length, _ in order])
    return found


class Text:
    """Runs of one text, by start and then period, and the words that are not repetitions."""

    def __init__(self, words: list[bytes], runs: list[Run]):
        self.words, self.runs = words, sorted(runs, key=lambda run: (run[0], run[2]))

    def strongest(self) -> Run | None:
        """The largest length / period, exactly; of equal ones the first by start, then period."""
        best = None
        for run in self.runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        return best

    def collapsed(self) -> bytes:
        if not self.runs:
            return b" ".join(self.words)
        dropped = np.zeros(len(self.words) + 1, np.int64)
        for start, length, period in self.runs:
            dropped[start + period] += 1
            dropped[start + length] -= 1
        kept = np.cumsum(dropped)[:-1] == 0
        return b" ".join([self.words[i] for i in np.flatnonzero(kept)])


def repeated(words: list[bytes], start: int, period: int) -> list[bytes]:
    """The words, those from ``start`` on replaced by repetitions of the ``period`` words there."""
    block = words[start : start + period]
    return (words[:start] + block * (-(-(len(words) - start) // period)))[: len(words)]


def texts_of(group: list[tuple[str | None, int | None, int | None]]) -> Iterator[Text]:
    """Each text with its runs. With a start and a period the text is repeated from there first."""
    words, ids, texts, numbers = [], [], [], {}
    for i, (text, start, period) in enumerate(group):
        # On bytes, `split` takes the six ASCII spaces, and nothing else, for spaces.
        own = (text or "").encode().split()
        if period:
            own = repeated(own, start, period)
        words.append(own)
        ids.extend([numbers.setdefault(word, len(numbers)) for word in own])
        texts.append(np.full(len(own), i, np.int64))
    ids = np.array(ids, np.int64)
    first = np.cumsum([0, *map(len, words)])
    runs: list[list[Run]] = [[] for _ in group]
    texts = np.concatenate(texts)
    for a, b in segments(ids, texts):
        i = int(texts[a])
        runs[i] += [(int(a + start - first[i]), length, period) for start, length, period in runs_in(ids[a:b])]
    return (Text(own, found) for own, found in zip(words, runs, strict=True))


RUN = "struct<start: bigint, length: bigint, period: bigint>"
FOUND = f"struct<runs: array<{RUN}>, strongest: {RUN}, collapsed: string>"


def finder():
    """A column function: text, start, period -> its runs, the strongest of them, what is left of the text.

    Start and period say from which word on the text is to be repeated before; null: not at all."""

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array, starts: pa.Array, periods: pa.Array) -> pa.Array:
        out, group, size = [], [], 0

        def flush():
            for text in texts_of(group):
                best = text.strongest()
                runs = [dict(zip(PARTS, run, strict=True)) for run in text.runs]
                one = dict(zip(PARTS, best, strict=True)) if best else None
                out.append({"runs": runs, "strongest": one, "collapsed": text.collapsed().decode()})

        for text, start, period in zip(texts, starts, periods, strict=True):
            group.append((text.as_py(), start.as_py(), period.as_py()))
            size += len(group[-1][0] or "")
            if size >= GROUP_BYTES:
                flush()
                group, size = [], 0
        if group:
            flush()
        run = pa.struct([(name, pa.int64()) for name in PARTS])
        return pa.array(out, pa.struct([("runs", pa.list_(run)), ("strongest", run), ("collapsed", pa.string())]))

    return find


def word_count(text: Column) -> Column:
    """The number of words; a null text has none."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def periodic_runs(docs: DataFrame, text: str = "text", start: Column | None = None, period: Column | None = None) -> DataFrame:
    """All columns, and ``runs`` (array of ``start``, ``length``, ``period``, in words, by start, then
    period), ``strongest`` (the run of largest length / period, ties to the smallest start, then
    period; null without runs), and ``collapsed``: the words without those that any run contains
    after its first period, joined by one space.

    A run is a stretch of words with smallest period q, at least max(6, 4 q) long, that no word
    beside it continues. Words are what ASCII spaces separate, compared as they are. A null or empty
    text has no words, no runs, and nothing left. Rows are independent: ties, repeated rows and an
    empty table need no rule; columns called like the new ones are kept as ``<name>_in``. ``start``
    and ``period`` (word number, words) repeat a text from there on before it is searched, where
    both are set: planted cases, for tests of what follows.
    """
    with_python(docs.sparkSession)
    asked = [F.lit(None) if column is None else column for column in (start, period)]
    names = [name for name in docs.columns if name != text]
    own = docs.select(text, *names)
    own = adding(own, "runs", "strongest", "collapsed")
    # The expressions name columns of the documents as they came.
    found = finder()(F.col(f"`{text}`"), *[column.cast("long") for column in asked])
    given = docs.select(text, *names, found.alias("found")).toDF(*own.columns, free_name(own, "found"))
    got = F.col(given.columns[-1])
    return given.select(*own.columns, *[got[name].alias(name) for name in ("runs", "strongest", "collapsed")])


def listed(runs: Column) -> Column:
    """Runs as text: start, length and period by commas, a line each."""
    line = lambda run: F.concat(F.concat_ws(",", *[run[name].cast("string") for name in PARTS]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
