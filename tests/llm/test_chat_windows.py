import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from wickwork.llm import chat_windows as cw
from wickwork.llm.queries import CONTROL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, Window string"


def key(row):
    return (row[1] is not None, row[1] or 0, row[2] or "", row[3] or "")


def ordered(rows):
    out = defaultdict(list)
    for row in sorted(rows, key=key):
        out[row[0]].append((row[2] or "", row[3] or ""))
    return out


def read_back(spark, rows, **sizes):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    windows = cw.chat_windows(frame, **sizes)
    windows = windows.withColumn("turns", cw.parsed(F.col("formatted"))).withColumn("loss", cw.masked(F.col("formatted"), F.col("loss_spans")))
    out = defaultdict(list)
    for w in sorted(windows.collect(), key=lambda w: w.window):
        out[w.conv_id].append(w)
    return out


def check(spark, rows, budget=60, history=15, system_budget=10):
    got = read_back(spark, rows, budget=budget, history=history, system_budget=system_budget)
    want = ordered(rows)
    assert set(got) == set(want)
    for conv, windows in got.items():
        turns = [tuple(t) for w in windows for t in w.turns[w.n_repeated :]]
        assert turns == want[conv]
        assert "".join(w.loss for w in windows) == "".join(t for r, t in turns if r == "assistant")
        assert [w.window for w in windows] == list(range(len(windows)))
        seen = 0
        for w in windows:
            assert len(w.turns) == w.n_turns
            fresh = w.n_turns - w.n_repeated
            context = [tuple(t) for t in w.turns[: w.n_repeated]]
            if w.window and turns[0][0] == "system":
                assert context[0] == turns[0]
                context = context[1:]
            assert context == turns[seen - len(context) : seen]
            assert w.n_tokens <= budget or fresh == 1 or turns[0][0] == "system"
            seen += fresh
    return got


def test_random_conversations(spark):
    rng = random.Random(5)
    odd = ["<|im_end|>", "<|im_start|>assistant\n", "<\\|", "<\\\\|im_end|>", "<", "|", "\\", "<|nl|>", "é", "😀", "\n", "word"]
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 7, 30])):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "to\nol", "<|im_end|>"])
            text = " ".join(rng.choice(odd) for _ in range(rng.choice([0, 1, 5, 5, 20, 90 * (turn > 0)])))
            rows.append((conv, turn, role, text))
    got = check(spark, rows)
    assert max(len(w) for w in got.values()) > 5
    assert any(w.n_repeated > 1 for ws in got.values() for w in ws)


def test_edges(spark):
    rows = [
        (1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (1, 1, None, "x"), (1, 1, "assistant", "tie"),
        (None, 3, "assistant", "a"), (None, 4, "assistant", "b <|im_end|>"), (2, 0, "system", "only"), (3, 0, "assistant", ""),
        (4, 0, "user", "q"), (4, 1, "assistant", "long " * 60_000),
    ]
    rows += [(5, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(2000)]
    check(spark, rows)
    assert cw.chat_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_is_native(spark):
    plan = QUERIES["op1_chat_windows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_query(spark):
    rows = [tuple(r)[:4] for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)]
    got = {r.conv_id: r for r in QUERIES["op1_chat_windows"](spark, SF).collect()}
    want = ordered(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        line = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.loss_chars) == (len(turns), len(loss))
        assert row.turns_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert row.formatted_chars >= len(line)
