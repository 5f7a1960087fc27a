import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wickwork.llm import spelling_variants as sv
from wickwork.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words, least, occurrences, ratio=2):
    n = {w: c for w, c in Counter(w for w in words if w is not None and len(w) >= least).items() if c >= occurrences}
    form, out = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = len(near)
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


def table(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def run(spark, words, least=1, occurrences=1):
    rows = [tuple(r) for r in sv.spelling_variants(table(spark, words).repartition(3), least, occurrences).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("alphabet", ["ab", "aéÿ", "abcdefgh", "a日🙂"])
def test_random_words(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = ["".join(rng.choices(alphabet, k=rng.randint(1, 5))) for _ in range(120)]
    words += [w for w in words for _ in range(rng.choice((0, 0, 1, 3, 9)))]
    assert run(spark, words) == brute(words, 1, 1)
    assert run(spark, words, 2, 3) == brute(words, 2, 3)


def test_chains_and_ties(spark):
    words = ["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["bbbbb"] * 96
    words += ["xyzzy"] * 3 + ["xyzza"] * 6 + ["xyzz"] * 6  # of one count: the first in order
    words += ["hello"] * 4 + ["hallo"] * 7  # not twice as frequent
    rows = run(spark, words, 4, 3)
    assert rows == brute(words, 4, 3)
    by = {r[0]: r for r in rows}
    assert by["aaaaa"][1:3] == ("aaaab", "bbbbb") and by["xyzzy"][1] == "xyzz" and by["hello"][1:] == (None, "hello", 4, 1, None)


def test_equal_letters_count_once(spark):
    words = ["aaaa"] * 2 + ["aaaaa"] + ["baaa"]
    assert {r[0]: r[4] for r in run(spark, words)} == {"aaaa": 2, "aaaaa": 1, "baaa": 1}


def test_a_hot_place(spark):
    """Hundreds of words that differ in one place are one group, read without pairs."""
    words = [f"stem{chr(0x4E00 + i)}s" for i in range(400)] + ["stems"]
    rows = {r[0]: r for r in run(spark, words)}
    assert all(rows[w][4] == 400 for w in words)
    turned = sv.rotations(sv.word_counts(table(spark, words), 1, 1))
    assert sv.scanned(turned).count() < 2 * turned.count()


def test_edges(spark):
    assert run(spark, []) == set()
    assert run(spark, [None, "", None]) == set()
    assert run(spark, ["a", "", None, "b"], 0, 1) == brute(["a", "", "b"], 0, 1)
    long = "x" * 3000
    assert run(spark, [long, long[:-1] + "y"]) == {(long, None, long, 1, 1, None), (long[:-1] + "y", None, long[:-1] + "y", 1, 1, None)}
    assert run(spark, ["a\x00b", "a\x00c"]) == {("a\x00b", None, "a\x00b", 1, 0, None), ("a\x00c", None, "a\x00c", 1, 0, None)}
    clash = spark.createDataFrame([("abcde", 1, "x")] * 3, "n string, word int, prefix string")
    assert [tuple(r) for r in sv.spelling_variants(clash).collect()] == [("abcde", None, "abcde", 3, 0, None)]


def test_runs(spark):
    texts = ["Straße ÀB÷× naïve", None, "", "ABCDEF-ghijk9lmnop ÿÿÿÿÿĀāāāāā", "x" * 100_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(sv.letter_runs(F.col("text"), 3).alias("runs"))
    lower = str.maketrans(sv.UPPER, sv.LOWER)
    want = [[w.translate(lower) for w in re.findall("[A-Za-zÀ-ÿ]+", t or "") if len(w) >= 3] for t in texts]
    assert [r["runs"] for r in rows.collect()] == want
    cut = spark.createDataFrame([("aéc", i) for i in range(3)], "w string, i int").select(sv.without(F.col("w"), F.col("i")).alias("w"))
    assert [r["w"] for r in cut.collect()] == ["éc", "ac", "aé"]


def test_query(spark):
    """By its definition; the pairs are found by a plain look-up of all edits."""
    words = []
    lower = str.maketrans(sv.UPPER, sv.LOWER)
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for word in re.findall("[A-Za-zÀ-ÿ]+", row["text"] or ""):
            word = word.translate(lower)
            h = zlib.crc32(f"{row['doc_id']}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            words.append(word)
    n = {w: c for w, c in Counter(words).items() if len(w) >= 5 and c >= 3}
    letters = sorted({c for w in n for c in w})
    form, count = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = (edits - {w}) & n.keys()
        count[w] = len(near)
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    got = {r["word"]: r for r in QUERIES["op11_spelling_variants"](spark, SF).collect()}
    assert got.keys() == n.keys()
    for w, r in got.items():
        assert (r["n"], r["n_near"], r["form"], r["form_n"]) == (n[w], count[w], form[w], n.get(form[w]))
        root = w
        while form[root]:
            root = form[root]
        assert r["root"] == root


def test_sql(spark):
    with connect(SF) as con:
        assert differences(spark, con, QUERIES["op11_spelling_variants"], ORACLES["op11_spelling_variants"], SF) is None
