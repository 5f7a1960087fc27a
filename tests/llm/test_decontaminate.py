import re

import pytest

from wickwork.llm import decontaminate as dc
from wickwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TRAIN = "A train leaves the station of Oslo at 9:30 and travels 120 km to Bergen before it returns to Oslo with 40 more people on board"
SHORT = "who wrote the book"


@pytest.fixture()
def bench(spark):
    def make(*rows):
        return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string")

    return make


def found(frame):
    return {(r.doc_id, r.item_id): r for r in frame.collect()}


def test_verbatim_reparameterised_and_clean(spark, docs, bench):
    other = TRAIN.replace("Oslo", "Malmo").replace("Bergen", "Lund").replace("120", "75").replace("9:30", "11").replace("40", "3")
    mixed_up = TRAIN.replace("returns to Oslo", "returns to Paris")
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    rows = [
        (1, TRAIN),
        (2, f"{filler} {TRAIN} {filler}"),
        (3, f"{filler} {other}."),
        (4, f"{filler} {mixed_up}."),
        (5, filler),
        (6, "He asked me: Who wrote the Book?".replace("Book", "book")),
        (7, " ".join(TRAIN.split()[3:18])),
        (8, " ".join(TRAIN.split()[3:12])),
        (9, re.sub(r"(\w{5,})", r"\1,", TRAIN)),
    ]
    got = found(dc.leaks(docs(*rows), bench((10, TRAIN), (11, SHORT), (12, None), (13, ""))))
    # 4 holds twelve windows word for word before its one changed name.
    assert set(got) == {(1, 10), (2, 10), (3, 10), (4, 10), (6, 11), (7, 10), (9, 10)}
    assert [got[k].reparameterised for k in sorted(got) if k != (4, 10)] == [False, False, True, False, False, False]
    assert got[(4, 10)].n_changed == 1
    assert got[(3, 10)].n_changed >= 4
    left = dc.decontaminated(docs(*rows), bench((10, TRAIN), (11, SHORT)))
    assert left.columns == docs().columns
    assert sorted(r.doc_id for r in left.collect()) == [5, 8]


def test_one_inconsistent_value_does_not_hide_the_rest(spark, docs, bench):
    repeated = TRAIN.replace("returns to Oslo", "returns to Paris")
    merged = TRAIN.replace("40", "120")
    renamed = repeated.replace("9:30", "8:15").replace("Bergen", "Lund")
    # The same name stands for two in every window that has both; 'a b' apart, none is left whole.
    chance = "Anna paid Berta and Clara paid Dora and Emma paid Frieda while we saw it"
    rows = [(1, repeated), (2, merged), (3, renamed), (4, " ".join(renamed.split()[:19])), (5, re.sub("Berta|Clara|Dora|Emma|Frieda", "Anna", chance))]
    got = found(dc.leaks(docs(*rows), bench((10, TRAIN), (11, f"then {chance}"))))
    assert set(got) == {(1, 10), (2, 10), (3, 10), (4, 10)}
    assert got[(1, 10)].n_changed == 1 and got[(1, 10)].n_matched == got[(1, 10)].n_windows
    assert got[(3, 10)].n_matched >= got[(4, 10)].n_matched


def test_items_of_few_words(spark, docs, bench):
    names = "Did Anna Berta Clara Dora Emma Frieda Gerda Hanna and Ida meet Jana Klara Lena Maria in Oslo"
    items = bench((10, "What is 3 plus 4?"), (11, "What is 12 + 30?"), (12, "1 2 3 5 8 13 21 34 55 89"), (13, names), (14, TRAIN + " 1 2 3 4 5 6 7 8 9"))
    rows = [
        (1, "We ask: what is 3 plus 4? Seven."),
        (2, "x What is 12 + 30? y"),
        (3, "the row 1, 2, 3, 5, 8, 13, 21, 34, 55, 89 of numbers"),
        (4, f"so: {names}?"),
        (5, "We ask: what is 3 plus 5? Eight. What is 1230? The row 1 2 3 5 8 14 22 35 56 90"),
        (6, " ".join(TRAIN.replace("Oslo", "Malmo").replace("40", "3").split()[:18])),
    ]
    got = found(dc.leaks(docs(*rows), items))
    assert set(got) == {(1, 10), (2, 11), (3, 12), (4, 13), (6, 14)}
    assert [got[k].n_changed for k in sorted(got)] == [0, 0, 0, 0, 1]


def test_case_and_line_breaks_do_not_matter(spark, docs, bench):
    words = TRAIN.split()
    wrapped = TRAIN.replace(" Oslo", "\nOslo").replace(" Bergen", "\r\n  Bergen").replace("120 km", "120\u00a0km")
    rows = [
        (1, TRAIN.lower()),
        (2, TRAIN.upper()),
        (3, " ".join(w[0].upper() + w[1:] for w in words)),
        (4, wrapped),
        (5, TRAIN.lower().replace("120", "75").replace("40", "3")),
        (6, "who\twrote THE\nbook"),
        (7, "\n".join(words)),
        (8, TRAIN.lower()[:30]),
    ]
    got = found(dc.leaks(docs(*rows), bench((10, TRAIN), (11, SHORT))))
    assert set(got) == {(d, 10) for d in (1, 2, 3, 4, 5, 7)} | {(6, 11)}
    assert {d: r.n_changed for (d, _), r in got.items()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 2, 6: 0, 7: 0}
    assert all(r.n_matched == r.n_windows for r in got.values())
    upper = found(dc.leaks(docs((1, TRAIN), (2, TRAIN.lower())), bench((10, TRAIN.upper()))))
    assert set(upper) == {(1, 10), (2, 10)}


def test_edges(spark, docs, bench):
    rows = [(1, None), (1, ""), (2, TRAIN), (2, TRAIN), (2, "another text"), (None, TRAIN), (3, TRAIN + " ." * 50_000), (4, (TRAIN + " ; ") * 3)]
    items = bench((10, TRAIN), (10, TRAIN), (None, TRAIN))
    got = found(dc.leaks(docs(*rows).withColumnRenamed("lang", "ITEM_id"), items))
    assert set(got) == {(d, i) for d in (2, None, 3, 4) for i in (10, None)}
    left = dc.decontaminated(docs(*rows), items)
    assert sorted((r.doc_id, r.text) for r in left.where("doc_id = 2 or text = ''").collect()) == [(1, ""), (2, "another text")]
    assert left.count() == 3
    assert dc.leaks(docs(), items).count() == 0
    assert dc.leaks(docs(*rows), bench()).count() == 0
    assert dc.leaks(docs(*rows), bench((1, None))).count() == 0


def test_shuffled_join_gives_the_same(spark, docs, bench, monkeypatch):
    rows, items = [(1, TRAIN), (2, "x y z")], bench((10, TRAIN))
    want = dc.leaks(docs(*rows), items).collect()
    monkeypatch.setattr(dc, "BROADCAST", 0)
    assert dc.leaks(docs(*rows), items).collect() == want


def test_query_finds_every_quoted_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()

    def plain(text):
        return " ".join(re.sub(r"[^\w\s]", "", text.lower()).split())

    texts = {d.doc_id: f" {plain(d.text or '')} " for d in docs}
    whole = {(d, i.item_id) for d, t in texts.items() for i in items if f" {plain(i.text)} " in t}
    runs = {i.item_id: plain(i.text).split() for i in items}
    partly = {(d, i) for i, w in runs.items() for k in range(len(w) - 12) for d, t in texts.items() if f" {' '.join(w[k : k + 13])} " in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, SF).collect()}
    assert whole and whole <= got
    assert got <= whole | partly
