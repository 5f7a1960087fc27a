import random
import re

import numpy as np
import pytest

from wickwork.llm import near_dedup as nd

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, width):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    size = min(width, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows, width, threshold):
    """component by row index, by comparing all pairs."""
    sets = [shingles(text, width) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    smallest = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), smallest[root(i)]) for i in range(len(rows))]


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 6, 12, 40, 120])))
        rows.append((i * 3 + 1, text if rng.random() < 0.8 else text.upper()))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, large, size", [(2, 64, 1 << 20), (5, 8, 1 << 20), (2, 1, 2000)])
def test_components_against_all_pairs(spark, docs, monkeypatch, width, large, size):
    monkeypatch.setattr(nd, "LARGE", large)
    monkeypatch.setattr(nd, "BLOCK", 16 * large)
    monkeypatch.setattr(nd, "BLOCK_BYTES", size)
    rows = corpus(width)
    got = nd.near_duplicates(docs(*rows), width).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, width, 80))


def test_edges_and_deduplicated(spark, docs):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (5, base), (2, base + " end"), (9, base.upper()), (9, base.upper()), (None, base), (7, None), (8, ""), (8, ""),
        (1, " \t\n"), (3, "one"), (4, "ONE"), (None, "alone here"), (11, "ß  x"), (6, "other " * 30000), (12, "other " * 30000),
    ]
    frame = docs(*rows).withColumnRenamed("lang", "component_ID")
    got = nd.near_duplicates(frame, 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute(rows, 2, 80), key=str)
    left = nd.deduplicated(docs(*rows), 2)
    assert left.columns == docs().columns
    ids = sorted((str(r.doc_id), len(r.text or "")) for r in left.collect())
    want = [("2", len(base) + 4), ("7", 0), ("8", 0), ("8", 0), ("1", 3), ("3", 3), ("None", 10), ("11", 4), ("6", 180000)]
    assert ids == sorted(want)
    repeated = nd.deduplicated(docs((2, base), (2, base), (3, base)), 2).collect()
    assert [r.doc_id for r in repeated] == [2]
    assert nd.near_duplicates(docs(), 2).count() == 0 == nd.deduplicated(docs()).count()


def test_chain_and_large_group(spark, docs):
    """A chain of neighbours ends far from its start; a hundred variants of one text are one component."""
    words = [f"w{i}" for i in range(300)]
    chain = [(i, " ".join(words[20 * i : 20 * i + 200])) for i in range(5)]
    base = [f"v{i}" for i in range(100)]
    variants = [(100 + i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(100)]
    got = nd.near_duplicates(docs(*chain, *variants), 2).collect()
    assert {r.component_id for r in got if r.doc_id < 100} == {0}
    assert {r.component_id for r in got if r.doc_id >= 100} == {100}


def test_common_members(monkeypatch):
    monkeypatch.setattr(nd, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, 60, size, dtype=np.uint64)) for size in sizes] for sizes in ([5, 30, 1], [9, 40, 3, 20]))
    want = [[len(set(a) & set(b)) for b in right] for a in left]
    assert nd.common_members(left, right).tolist() == want


def test_estimate():
    rng = np.random.default_rng(1)
    for n, share in [(2000, 0.9), (2000, 0.5), (400, 0.8), (2000, 0.0)]:
        errors = []
        for _ in range(20):
            pool = rng.integers(1, 2**63, 2 * n, dtype=np.uint64)
            common = round(2 * n * share / (1 + share))
            a, b = np.unique(pool[:n]), np.unique(pool[n - common : 2 * n - common])
            sketch = [nd.registers(x)[None] for x in (a, b)]
            errors.append(nd.estimate(*sketch, np.array([n]), np.array([n]))[0] - share)
        assert abs(np.mean(errors)) < 0.02
        assert np.max(np.abs(errors)) < 0.12


@pytest.mark.parametrize("n", [9, 40, 200, 1500])
def test_links_lost_at_the_threshold(n):
    """Of pairs at 0.80 to 0.82 none fails to share a band, and the estimate rejects none."""
    rng = np.random.default_rng(n)
    common, lost, tried = -(-n * 8 // 9), 0, 1500 if n < 1000 else 400
    assert 0.8 <= common / (2 * n - common) <= 0.82
    for _ in range(tried):
        pool = np.unique(rng.integers(1, 2**63, 2 * n - common, dtype=np.uint64))
        pool = rng.permutation(pool)
        a, b = nd.registers(np.sort(pool[:n])), nd.registers(np.sort(pool[n - common :]))
        share = (a == b).reshape(nd.BANDS, nd.ROWS).all(axis=1).any()
        least = 0.8 - nd.SLACK * np.sqrt(0.8 * 0.2 / min(n, nd.BUCKETS))
        lost += not (share and nd.estimate(a[None], b[None], np.array([n]), np.array([n]))[0] >= least)
    assert lost == 0


def test_pairs_grow_with_the_documents(spark, docs, monkeypatch):
    """A group whose members all lie just below the threshold: rows of pairs in proportion to it."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]

    def group(n):
        rows = []
        for i in range(n):
            words = list(base)
            for at in rng.sample(range(300), 19):
                words[at] = f"x{rng.random()}"
            rows.append((i, " ".join(words)))
        return rows

    made, call = [], nd._Linker.__call__
    monkeypatch.setattr(nd._Linker, "__call__", lambda self, pairs: made.append(pairs.count()) or call(self, pairs))
    totals = []
    for n in (150, 300):
        made.clear()
        rows = group(n)
        got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs(*rows), 2).collect()}
        assert got == {d: c for d, _, c in brute(rows, 2, 80)}
        totals.append(sum(made))
    assert totals[1] <= 2.3 * totals[0]


def test_nothing_is_broadcast(spark, docs, monkeypatch):
    """Tables that grow with the documents do not pass through the driver, though their files are small here."""
    plans, write = [], nd.written

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(nd, "written", lambda df, name: write(ran(df), name))
    monkeypatch.setattr(nd, "LARGE", 3)
    rows = corpus(5, 60)
    got = ran(nd.near_duplicates(docs(*rows), 2)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 2, 80))
    assert any("SortMergeJoin" in plan for plan in plans)
    assert [plan for plan in plans if "Broadcast" in plan] == []
