"""Python workers outlive their tasks: what a function has freed must not stay with its process."""

import pathlib
import re

import numpy as np
import pyarrow as pa
import pytest

from wickwork.llm import kneser_ney, near_dedup, personal_data
from wickwork.llm.tables import release, releasing


def held() -> float:
    """MB of this process's own memory."""
    return int(re.search(r"\nAnonymous:\s+(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def texts(seed: int) -> pa.Array:
    """8 MB, words of random letters."""
    letters = np.random.default_rng(seed).choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    ", np.uint8), (1000, 8000))
    return pa.array([row.tobytes().decode() for row in letters], pa.string())


def count():
    for _ in kneser_ney._counted(pa.RecordBatch.from_arrays([texts(i)], ["text"]) for i in range(2)):
        pass


def redact():
    assert len(personal_data.redact_text.func(texts(0))) == 1000
    assert len(personal_data.redact_text.func(pa.array(["a"]))) == 1


def sketch():
    assert len(near_dedup.set_of(5).func(texts(0))) == 1000
    assert len(near_dedup.set_of(5).func(pa.array(["a"]))) == 1


@pytest.mark.parametrize("work", [count, redact, sketch])
def test_freed_memory_is_given_back(work):
    work()  # what stays for good: automata, tables of modules
    release()
    before = held()
    work()
    assert held() - before < 8


def test_results_and_errors_pass_through():
    def pairs(batches):
        for x in batches:
            yield x
            yield x + 1

    def fails(x):
        raise KeyError(x)

    assert list(releasing(pairs)([1, 5])) == [1, 2, 5, 6]
    assert list(releasing(pairs)([])) == []
    assert releasing(max)(2, 3) == 3
    with pytest.raises(KeyError):
        releasing(fails)(1)
