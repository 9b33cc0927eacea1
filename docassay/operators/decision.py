"""Decision tables: measures within limits, and the first row of a table that holds."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Limits = dict[str, tuple[float | None, float | None]]


def within(limits: Limits) -> Column:
    """Whether every measure lies between its limits, both inclusive; None is no limit."""
    tests = [F.col(measure) >= low for measure, (low, _) in limits.items() if low is not None]
    tests += [F.col(measure) <= high for measure, (_, high) in limits.items() if high is not None]
    return reduce(Column.__and__, tests)


def holds(condition: str, named: dict[str, Column]) -> Column:
    """A condition in the words of a table: alternatives parted by "or", names parted by "and", each with "no" before it or not."""

    def single(word: str) -> Column:
        return ~named[word[3:]] if word.startswith("no ") else named[word]

    return reduce(Column.__or__, (reduce(Column.__and__, (single(w.strip()) for w in part.split(" and "))) for part in condition.split(" or ")))


def first_of(rows: Iterable[tuple[str, Column]], named: dict[str, Column], other: Column) -> Column:
    """The value of the first row whose condition holds."""
    out = None
    for condition, value in rows:
        out = F.when(holds(condition, named), value) if out is None else out.when(holds(condition, named), value)
    return out.otherwise(other)
