"""Joins by keys of which null is one like others."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """The columns of ``left`` and the others of ``right``; null keys match null keys."""
    named = right.select(*[F.col(name).alias(f"_on_{name}" if name in on else name) for name in right.columns])
    same = reduce(and_, [left[name].eqNullSafe(named[f"_on_{name}"]) for name in on])
    return left.join(named, same, how).drop(*[f"_on_{name}" for name in on])
