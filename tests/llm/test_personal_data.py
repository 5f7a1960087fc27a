import hashlib
import random
import re

from wickwork.llm import personal_data as pd_

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    """The four patterns searched over the whole text."""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    pieces = [
        "a@b.c", "@", "x.y", ".", "-", "+", " ", "1", "255", "256", "0007", "4041894974608795", "4111-1111 1111 1111",
        "+1 (456) 555-2186", "é", "日", "@a.b", "a@", "..", "1.2.3.4", "9" * 20, "0", "\n", "%", "_", "(", ")", "😀",
    ]
    for _ in range(20000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert [s for s in pd_.find(text) if s[0] in pd_.BASE] == base(text), text


def test_added_kinds():
    def of(text, kind):
        return [text[s:e] for k, s, e in pd_.find(text) if k == kind]

    assert of("see https://a.example/b?c=1, or ftp://h.", "url") == ["https://a.example/b?c=1", "ftp://h"]
    assert of("gopher://a.b and ://x", "url") == []
    assert of("IBAN: DE89 3704 0044 0532 0130 00 is mine", "account") == ["DE89 3704 0044 0532 0130 00"]
    assert of("IBAN DE88370400440532013000", "account") == []
    assert of("Account no. 123-456-789 and accounts 123456", "account") == ["123-456-789"]


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1 " * 100_000, "+1" * 100_000, "a.1." * 100_000, "account " * 50_000, "@" * 200_000):
        pd_.find(text)


def test_redacted():
    assert pd_.redacted("to a.b@mail.example.com or 42.144.35.254!") == "to [EMAIL] or [IP]!"
    assert pd_.redacted("https://u@h.example.com/1.2.3.4 x") == "[URL] x"
    assert pd_.redacted("") == ""


def test_frames(spark, docs):
    rows = [(1, "x a@b.cd y"), (1, "x a@b.cd y"), (2, None), (3, ""), (None, "z " * 100_000 + "1.2.3.4")]
    frame = docs(*rows).withColumnRenamed("lang", "SPANS")
    found = pd_.find_personal_data(frame)
    assert "SPANS_in" in found.columns
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in found.collect()), key=str)
    assert got == sorted(((d, pd_.find(t or "")) for d, t in rows), key=str)
    clean = pd_.redact(docs(*rows))
    assert clean.columns == docs().columns
    assert sorted((r.text for r in clean.collect() if r.doc_id == 1)) == ["x [EMAIL] y"] * 2
    assert [(r.text, r.n_chars) for r in clean.where("doc_id in (2, 3)").orderBy("doc_id").collect()] == [(None, None), ("", 0)]
    assert pd_.find_personal_data(docs()).count() == 0 == pd_.redact(docs()).count()


def test_query_against_patterns(spark):
    from wickwork.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_personal_data"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id] or "")
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, *_ in want) for k in pd_.BASE)
        assert r.spans.startswith(line)
