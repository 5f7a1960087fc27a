import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wickwork.llm import token_counts as tc
from wickwork.llm.queries import QUERIES

PATH = public_tokenizers.path(tc.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


CASES = [
    None,
    "",
    " ",
    "a",
    "It's  we'll\n\n  they'd 'sup ''s",
    "x<|endoftext|>y  <|endoftext|><|endoftext|> <|endoftext",
    "<|endoftext|>",
    "tab\tand\x0b\x1c\x85\xa0spaces  \n ",
    "naïve Übergröße ÿÀ 12½ ³",
    "日本語 テキスト 🙂🙂 نص кириллица १२३",
    "՘֋ a࢏ ͸ x﷿",
    "é" * 300 + " " + "é" * 3000,
    "z" * 200_000,
    "word " * 50_000,
    "a\x00b\x00",
]


def test_as_the_library(spark, docs):
    rows = docs(*[(i, text) for i, text in enumerate(CASES)])
    got = {r["doc_id"]: r for r in tc.token_counts(rows.repartition(4), frequent=20).collect()}
    assert len(got) == len(CASES)
    for i, text in enumerate(CASES):
        n = library(text)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 512), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aé '\n\t1½!<|endoftx>日՘", max_size=40))
def test_pre_tokens_are_encoded_alone(text):
    text = text.encode("utf-8", "ignore").decode()
    own = tc.Counts(tc.cutter(PATH, public_tokenizers.PATTERN), tc.pack({}))
    words, special = own.own.cut(text)
    if not special:
        assert "".join(words) == text
    assert own.count([text, text]) == [library(text)] * 2


def test_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(tc, "CACHED", 5)
    own = tc.Counts(tc.cutter(PATH, public_tokenizers.PATTERN), tc.pack({" the": 1}))
    texts = [f"one the {i} words{i} the" for i in range(30)]
    assert [own.count([text])[0] for text in texts] == list(map(library, texts))
    assert len(own.known) <= 1 + 5 + 6 and own.known[" the"] == 1


def test_table_round_trip():
    lengths = {" the": 1, "日本": 3, "x" * tc.KEPT_CHARS: 300, "\x00": 1}
    assert tc.unpack(tc.pack(lengths)) == lengths
    assert tc.unpack(tc.pack({})) == {}


def test_frequent_words_cover_all_rows(spark, docs, monkeypatch):
    rows = docs(*[(i, "the cat the cat sat") for i in range(40)], (50, None), (51, "x" * 100))
    got = {r["word"]: r["n"] for r in tc.frequent_words(rows.select("text").repartition(5), 4).collect()}
    assert got == {" cat": 80, "the": 40, " sat": 40, " the": 40}
    table = tc.unpack(tc.frequent_lengths(rows.select("text"), 4))
    assert table == {word: library(word) for word in got}


def test_no_exchange_of_rows(spark, docs):
    counted = tc.token_counts(docs((1, "a b c")))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_edges(spark, docs):
    assert tc.token_counts(docs((1, "x")).where("doc_id = 2")).collect() == []
    rows = docs((1, "same"), (1, "same"), (None, None)).withColumnRenamed("lang", "N_Tokens").withColumnRenamed("source", "over_limit")
    got = tc.token_counts(rows)
    assert {"N_Tokens_in", "over_limit_in", "n_tokens", "over_limit", "n_bytes"} <= set(got.columns)
    assert sorted(r["n_tokens"] for r in got.collect()) == [0, 1, 1]
    odd = docs((1, "a b")).withColumnRenamed("text", "n_tokens")
    assert tc.token_counts(odd, text="n_tokens").first()["n_tokens"] == 2


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tc.Cutter(public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.PATTERN)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op13_token_counts"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        n = library(row["text"])
        assert (got[row["doc_id"]]["n_tokens"], got[row["doc_id"]]["over_limit"]) == (n, n > 512)
        assert got[row["doc_id"]]["n_bytes"] == len(row["text"].encode())
