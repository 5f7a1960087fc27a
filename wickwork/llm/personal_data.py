"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs, digits,
schemes, and words that announce an account (``iban``, ``account`` ...). A parser of its own kind
then works outwards from each anchor, to the left and to the right as far as the kind allows, and
checks what it found: domain labels, address parts, the Luhn sum, digit counts, the IBAN
remainder. No pattern is searched over the text.

Kinds, in the order in which spans are listed: email, ip, card, phone (the *base*), then url and
account, which the method adds. Spans of a kind do not overlap; those of different kinds may.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickwork.llm.tables import adding, releasing, with_python

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
SCHEMES = ("http", "https", "ftp")
#: Words that announce an account or a document number.
CUES = ("iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte", "passport", "ssn")
#: Between a cue and its number: at most so many characters of separators and small words.
CUE_GAP = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_GROUPS = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_HOST = re.compile(r"(?:[A-Za-z0-9._~%-]{1,64}@)?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*(:[0-9]{1,5})?([/?#][^\s<>\"']*)?")
_GAP = re.compile(r"(?:[\x20\t:#=.]|\b(?:number|no|nr|num)\b){0,%d}" % CUE_GAP, re.IGNORECASE)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20]?[A-Za-z0-9]){11,30}")
_ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])")

SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban(text: str) -> bool:
    """The remainder of 97 after moving the first four characters to the end."""
    plain = text.replace(" ", "").upper()
    moved = plain[4:] + plain[:4]
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors, with the kinds of parser that they start."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("://", ("url", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("account", len(form)))
    found.make_automaton()
    return found


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Local part to the left, not past ``floor``; labels to the right."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _url(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """A known scheme to the left of ``://``, a host and what follows it to the right."""
    start = at
    while start > floor and at - start < 6 and text[start - 1].isascii() and text[start - 1].isalpha():
        start -= 1
    if text[start:at].lower() not in SCHEMES:
        return None
    rest = _HOST.match(text, at + 3)
    if not rest:
        return None
    end = rest.end()
    while text[end - 1] in ".,;:!?)]}":
        end -= 1
    return start, end


def _account(text: str, cue: int, after: int) -> tuple[int, int] | None:
    """An IBAN with the right remainder, or 6 to 17 digits, shortly after a cue word."""
    if cue and text[cue - 1] in _WORD or after < len(text) and text[after] in _WORD:
        return None
    start = _GAP.match(text, after).end()
    number = _IBAN.match(text, start)
    if number:  # a following word may look like a further group
        end = number.end()
        while end - start >= 15:
            if (end == len(text) or text[end] not in _WORD) and iban(text[start:end]):
                return start, end
            end -= 1
    number = _ACCOUNT.match(text, start)
    return (start, number.end()) if number else None


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by kind as listed, then start; code points."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    reach = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin

    def take(kind: str, start: int, end: int) -> None:
        spans[kind].append((start, end))
        reach[kind] = end

    for last, (kind, length) in automaton().iter(text):
        at = last + 1 - length
        if kind == "digit":
            # Each run of digits is looked at once, from its first digit or from where the last match ended.
            if at >= reach["card"]:
                groups = _GROUPS.match(text, at)
                reach["card"] = groups.end() if groups else at + 1
                if groups:
                    digits = groups[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append((at, groups.end()))
            if at >= reach["ip"]:
                quad = _QUAD.match(text, at)
                # No match from here: none from a later digit of the same run either.
                reach["ip"] = quad.end() if quad else _DIGITS.match(text, at).end()
                if quad and all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in quad[0].split(".")):
                    spans["ip"].append((at, quad.end()))
        elif at < reach[kind]:
            continue
        elif kind == "email":
            if found := _email(text, at, reach[kind]):
                take(kind, *found)
        elif kind == "phone":
            number = _PHONE.match(text, at)
            if number:
                reach[kind] = number.end()
                if 8 <= sum(c.isdigit() for c in number[0]) <= 15:
                    spans[kind].append((at, number.end()))
        elif kind == "url":
            if found := _url(text, at, reach[kind]):
                take(kind, *found)
        elif found := _account(text, at, last + 1):
            take(kind, *found)
    return [(kind, start, end) for kind in KINDS for start, end in spans[kind]]


def redacted(text: str) -> str:
    """The text with each stretch of overlapping spans replaced by ``[KIND]`` of its first, longest span."""
    parts, done = [], 0
    spans = sorted(find(text), key=lambda span: (span[1], -span[2]))
    i = 0
    while i < len(spans):
        kind, start, end = spans[i]
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        parts += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*parts, text[done:]])


@F.arrow_udf(SPANS)
def spans_of(texts: pa.Array) -> pa.Array:
    rows = ([{"kind": k, "start": s, "end": e} for k, s, e in find(text or "")] for text in texts.to_pylist())
    return pa.array(rows, _ARROW)


@F.arrow_udf(T.StringType())
@releasing
def redact_text(texts: pa.Array) -> pa.Array:
    return pa.array([None if text is None else redacted(text) for text in texts.to_pylist()], pa.string())


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, and ``spans``: array of (kind, start, end), by kind as listed, then start.

    A null or empty text has no spans. Rows are independent: ties, repeated rows and an empty table
    need no rule. A column called ``spans`` is kept as ``spans_in``.
    """
    with_python(docs.sparkSession)
    names = [name for name in docs.columns if name != text]
    docs = adding(docs.select(text, *names), "spans")
    return docs.withColumn("spans", spans_of(F.col(docs.columns[0])))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same columns, with ``[KIND]`` in ``text`` for personal data, and ``length`` (where there
    is such a column) as the new number of characters. A null text stays null."""
    with_python(docs.sparkSession)
    changed = {text: redact_text(F.col(text))}
    out = docs.withColumns(changed)
    if length and length in docs.columns:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
