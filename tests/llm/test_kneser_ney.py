import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wickwork.llm import kneser_ney as kn
from wickwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Plain:
    """The model in dictionaries, by the textbook; texts are tuples of characters, '' stands before the start."""

    def __init__(self, texts):
        counts = Counter(g for t in texts for g in self.grams(t))
        self.c = {kn.ORDER: counts}
        for k in range(kn.ORDER - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.total, self.after = {}, {}, {}
        for k, table in self.c.items():
            self.d[k] = kn.discounts(*[sum(v == i for v in table.values()) for i in range(1, 5)])
            total, after = defaultdict(int), defaultdict(list)
            for g, v in table.items():
                total[g[:-1]] += v
                after[g[:-1]].append(v)
            self.total[k], self.after[k] = total, after

    @staticmethod
    def grams(text):
        padded = [""] * (kn.ORDER - 1) + list(text)
        return [tuple(padded[i : i + kn.ORDER]) for i in range(len(text))]

    def cut(self, k, count):
        return self.d[k][min(count, 3) - 1]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / 4096
        below, total = self.p(gram[1:]), self.total[k].get(gram[:-1])
        if not total:
            return below
        weight = sum(self.cut(k, v) for v in self.after[k][gram[:-1]]) / total
        own = self.c[k].get(gram)
        return (own - self.cut(k, own)) / total + weight * below if own else weight * below

    def perplexity(self, text):
        grams = self.grams(text)
        return math.exp(-sum(math.log(self.p(g)) for g in grams) / len(grams)) if grams else None


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randint(1, 6))) for _ in range(25)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30]))) for _ in range(n)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_perplexities_by_the_textbook(spark, docs, monkeypatch, broadcast):
    monkeypatch.setattr(kn, "GROUP_CHARS", 300)
    monkeypatch.setattr(kn, "HELD_GRAMS", 200)
    if not broadcast:
        monkeypatch.setattr(kn, "BROADCAST_GRAMS", 0)
        monkeypatch.setattr(kn, "CHUNK_BITS", 3)
    known, new = texts(1), [*texts(2), "", "Ω unseen 字", None]
    model = kn.Model(kn.gram_counts(docs(*enumerate(known)).select("text")))
    frame = docs(*enumerate(new))
    got = {r.doc_id: r.perplexity for r in kn.scorer(frame, model)(frame).collect()}
    plain = Plain(known)
    assert len(got) == len(new)
    for i, text in enumerate(new):
        # Characters that share a code are told apart by the plain model only.
        want = plain.perplexity(text or "")
        assert got[i] == (None if want is None else pytest.approx(want, rel=1e-4)), text


def test_probabilities_sum_to_one():
    plain = Plain(texts(3))
    letters = {g[0] for g in plain.c[1]}
    for context in list(plain.total[kn.ORDER])[:20]:
        seen = sum(plain.p((*context, c)) for c in letters)
        assert seen + (4096 - len(letters)) * plain.p((*context, "unseen")) == pytest.approx(1)


def test_quality(spark, docs):
    good = texts(4, 400)
    rows = [(i, t, "xx" if i % 2 else None, "s") for i, t in enumerate(good)]
    rows += [(1000, "ZQ#!" * 50, "xx"), (1001, None, "xx"), (1002, ""), (1000, "ZQ#!" * 50, "xx"), (None, good[0], "yy"), (1003, good[1] * 3000)]
    frame = docs(*rows).withColumnRenamed("source", "KEPT")
    trusted = spark.createDataFrame([(i,) for i in [*range(400), 5, None]], "doc_id long")
    out = kn.quality(frame, trusted)
    assert out.columns == ["doc_id", "text", "lang", "KEPT", "n_chars", "perplexity", "threshold", "kept_"]
    got = out.collect()
    assert len(got) == len(rows)
    assert {r.kept_ for r in got if r.doc_id == 1000} == {False}
    assert all(r.kept_ and r.perplexity is None for r in got if r.doc_id in (1001, 1002))
    assert sum(r.kept_ for r in got if r.doc_id is not None and r.doc_id < 400) >= 390
    assert all(r.kept for r in kn.quality(docs(*rows), trusted.where("false")).collect())
    assert kn.quality(docs(), trusted).count() == 0


def test_every_language_has_its_own_threshold(spark, docs):
    rng = random.Random(6)
    hard = ["".join(rng.choice("fghijklmnopqrstuvwxyz ") for _ in range(60)) for _ in range(60)]
    rows = [(i, t, "xx") for i, t in enumerate(texts(5, 150))] + [(200 + i, t, "yy") for i, t in enumerate(hard)]
    rows += [(300 + i, t, None) for i, t in enumerate(texts(7, 30))]
    rows += [(900, "same text", "xx"), (901, "same text", "yy"), (902, "same text", None), (903, "same text", "zz")]
    trusted = spark.createDataFrame([(i,) for i in range(330)], "doc_id long")
    got = {r.doc_id: r for r in kn.quality(docs(*rows), trusted).collect()}
    assert len(got) == len(rows)
    xx, yy, none, zz = (got[i].threshold for i in range(900, 904))
    assert len({xx, yy, none, zz}) == 4 and xx < zz and xx < yy
    assert sum(got[i].kept for i in range(200, 260)) >= 57


def test_query_keeps_good_documents(spark):
    got = QUERIES["op8_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    joined = got.join(labels, "doc_id")
    good = joined.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = joined.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good >= 0.95 and bad <= 0.6
