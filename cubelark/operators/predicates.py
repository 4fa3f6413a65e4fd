"""Typed comparisons and their disjunctions of conjunctions."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Predicate:
    """`column op value`, compared as string, number or date; a value that isn't of the type is rejected."""

    column: str
    op: str
    value: object
    kind: str = "string"

    def to_column(self) -> Column:
        if self.op not in _OPS:
            raise ValueError(f"no such comparison: {self.op}")
        left, right = F.col(self.column), F.lit(self.value)
        if self.kind == "date":
            left, right = F.try_to_date(left.cast("string"), "yyyy-MM-dd"), right.cast("date")
        elif self.kind == "number":
            left, right = left.try_cast("double"), right.cast("double")
        elif self.kind == "string":
            left, right = left.cast("string"), right.cast("string")
        else:
            raise ValueError(f"no such type: {self.kind}")
        return F.coalesce(_OPS[self.op](left, right), F.lit(False))


def all_of(*parts: Predicate) -> tuple[Predicate, ...]:
    return parts


def any_of(*groups: tuple[Predicate, ...] | Predicate) -> Column:
    """The groups' conjunctions, joined by OR. No group at all lets every row pass."""
    made = [g if isinstance(g, tuple) else (g,) for g in groups]
    if not made:
        return F.lit(True)
    return reduce(operator.or_, [reduce(operator.and_, [p.to_column() for p in g]) for g in made])
