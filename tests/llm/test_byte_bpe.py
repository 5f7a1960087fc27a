import random

import public_tokenizers
import pytest
import tiktoken

from wickwork.llm import byte_bpe


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))


@pytest.fixture(scope="module")
def judge(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)


def test_every_token_is_reached_by_merges(codec, ranks):
    for token, rank in ranks.items():
        assert codec.model.encode(token.decode("latin-1").translate(codec.mapped)) == [rank]


def test_random_texts_as_tiktoken(codec, judge):
    rng = random.Random(7)
    pools = [range(32, 127), range(0, 0x300), range(0x3000, 0x9FFF), range(0x1F300, 0x1F600), [9, 10, 13, 32, 0xA0]]
    for _ in range(2000):
        text = "".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(0, 40)))
        ids = codec.encode(text)
        assert ids == judge.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_full_cache_changes_nothing(monkeypatch, judge):
    monkeypatch.setattr(byte_bpe, "CACHED", 3)
    codec = byte_bpe.Codec(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    text = "one two three one four five one two " * 5
    assert codec.encode(text) == judge.encode_ordinary(text)


def test_unknown_id_is_an_error(codec):
    with pytest.raises(KeyError):
        codec.decode([10**6])


def test_frame(spark, docs, judge):
    long = "x" * 100_000 + " word" * 50_000
    rows = [(1, "Straße & 東京"), (1, "Straße & 東京"), (2, None), (3, ""), (4, long), (None, "<|endoftext|>")]
    frame = docs(*rows).withColumnRenamed("lang", "N_Tokens")
    out = byte_bpe.encode_decode(frame)
    assert "N_Tokens_in" in out.columns
    got = sorted(((r.doc_id, r.token_ids, r.n_tokens, bytes(r.decoded)) for r in out.collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = judge.encode_ordinary(text or "")
        want.append((doc_id, ids, len(ids), (text or "").encode()))
    assert got == sorted(want, key=str)
    assert byte_bpe.encode_decode(docs()).count() == 0
