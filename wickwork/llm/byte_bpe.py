"""Byte-level BPE by a sentencepiece model that is written from the vocabulary, not trained.

A vocabulary of ranks (token bytes -> rank, one base64 pair per line) becomes a sentencepiece BPE
model: every byte is mapped to one printable character, a piece is a token's mapped bytes, its
score is the negative rank, so the merge with the lowest rank wins, and normalisation is the
identity. Texts are cut into pre-tokens by the pattern first; each pre-token is encoded alone, and
piece ids are ranks. Decoding maps ids back to bytes.

A vocabulary is some 50,000 short tokens. Tasks build their model from the file's bytes once per
process, and keep the ids of pre-tokens seen lately in a bounded cache.

Which characters are letters, numbers or spaces is the ``regex`` module's say. It may know
characters that Unicode added after the tables of another tokenizer were made.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from wickwork.llm.tables import adding, releasing, with_python

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens in each of the cache's two generations.
CACHED = 60_000
#: Longer pre-tokens (a text without a space) are not kept in the cache.
CACHED_CHARS = 40
#: Characters encoded together.
GROUP_CHARS = 500_000


def byte_characters() -> list[str]:
    """One printable character per byte: itself where it is printable, else the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model: piece id = rank, then one unknown piece.

    Ranks without a token get an unused piece, so that ids stay ranks.
    """
    chars = byte_characters()
    tokens = {rank: token for token, rank in ranks.items()}
    model = proto.ModelProto()
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = max(tokens, default=-1) + 2
    for name in ("bos_id", "eos_id", "pad_id"):
        setattr(model.trainer_spec, name, -1)
    model.trainer_spec.unk_id = max(tokens, default=-1) + 1
    norm = model.normalizer_spec
    norm.name = "identity"
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    for rank in range(max(tokens, default=-1) + 1):
        token = tokens.get(rank)
        kind = proto.ModelProto.SentencePiece.UNUSED if token is None else proto.ModelProto.SentencePiece.NORMAL
        piece = f"<unused {rank}>" if token is None else "".join(chars[b] for b in token)
        model.pieces.add(piece=piece, score=-float(rank), type=kind)
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    return model.SerializeToString()


def latin_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts of the first 256 characters, with its Unicode classes as ranges of
    these. The plain engine takes less than half the time of the one that knows the classes."""
    ranges = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        inside = [c for c in range(256) if regex.match(name, chr(c))]
        ranges[name] = "".join(f"\\x{c:02x}" for c in inside)
    out, in_class = [], False
    for piece in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.DOTALL):
        if piece in ranges:
            piece = ranges[piece] if in_class else f"[{ranges[piece]}]"
        elif piece == r"\S":
            piece = rf"[^{ranges[chr(92) + 's']}]"
        elif piece in "[]":
            in_class = piece == "["
        out.append(piece)
    return re.compile("".join(out))


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.cut_any = regex.compile(pattern).findall
        self.cut_latin = latin_pattern(pattern).findall
        self.mapped = dict(enumerate(byte_characters()))
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def resolve(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of pre-tokens: from the cache, the others encoded in one call."""
        out, new = {}, []
        for word in words:
            ids = self.known.get(word) or self.older.get(word)
            if ids:
                out[word] = ids
            else:
                new.append(word)
        if new:
            # One mapping for all; the byte 255 does not occur in UTF-8.
            mapped = b"\xff".join(map(str.encode, new)).decode("latin-1").translate(self.mapped).split(self.mapped[255])
            out.update(zip(new, map(tuple, self.model.encode(mapped, num_threads=1)), strict=True))
        for word in words:
            if len(word) <= CACHED_CHARS:
                if len(self.known) >= CACHED:  # what was used lately stays in reach
                    self.known, self.older = {}, self.known
                self.known[word] = out[word]
        return out

    def cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.cut_any(text)
        return self.cut_latin(text)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. Texts should be some million characters together at most."""
        cuts = [self.cut(text) for text in texts]
        ids = self.resolve(set().union(*cuts)).__getitem__
        return [list(chain.from_iterable(map(ids, words))) for words in cuts]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        """Raises ``KeyError`` for an id that is no rank."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _resolved(vocabulary: str) -> str:
    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


def groups(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in stretches of ``GROUP_CHARS`` or one more text."""
    group, size = [], 0
    for text in texts:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


CODED = T.StructType().add("token_ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())


def coder(vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
    """A column function: text -> (token_ids, decoded), the bytes being made from the ids.

    Both come from one call, so that a text is encoded once; ids are gathered as one flat buffer.
    """

    @F.arrow_udf(CODED)
    @releasing
    def code(texts: pa.Array) -> pa.Array:
        own = codec(_resolved(vocabulary), pattern)
        flat, ends, decoded = array("i"), array("i", [0]), []
        for group in groups(texts):
            for ids in own.encode_all(group):
                flat.extend(ids)
                ends.append(len(flat))
                decoded.append(own.decode(ids))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(decoded, pa.binary())], ["token_ids", "decoded"])

    return code


def encode_decode(
    docs: DataFrame,
    text: str = "text",
    vocabulary: str = VOCABULARY,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """All columns, and ``token_ids`` (array of int), ``n_tokens`` (long), ``decoded`` (binary).

    ``decoded`` is made from the ids. A null text counts as empty: no ids, no bytes. Rows are
    independent, so ties, repeated rows and an empty table need no rule; columns called like the
    new ones are kept as ``<name>_in``. ``vocabulary`` is a name of the public tokenizers or a
    path that every executor has.
    """
    with_python(docs.sparkSession)
    names = [name for name in docs.columns if name != text]
    docs = adding(docs.select(text, *names), "token_ids", "n_tokens", "decoded")
    coded = docs.withColumn("decoded", coder(vocabulary, pattern)(F.col(docs.columns[0])))
    ids = F.col("decoded.token_ids")
    return coded.select(
        *docs.columns, ids.alias("token_ids"), F.size(ids).cast("long").alias("n_tokens"), F.col("decoded.decoded").alias("decoded")
    )


def joined_ids(ids: Column) -> Column:
    """Ids as decimal text, joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
