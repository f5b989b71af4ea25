"""Rows of a table by one column's values, asked of the table itself where it can tell."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Asked = tuple[tuple[str, frozenset[str]], ...]


class Projected:
    """A table that is computed as one projection for each kind of row, and not stored.

    `build` gives the table without the projections that cannot hold the rows asked for. What is
    asked for is still filtered, so a projection left in changes no result; left out, it is no
    part of the plan. Everything else is asked of the table as a DataFrame.
    """

    def __init__(self, build: Callable[[Asked], DataFrame], asked: Asked = (), conditions: tuple = ()) -> None:
        self._build, self._asked, self._conditions = build, asked, conditions

    def only(self, column: str, *values: str) -> Projected:
        asked = (*self._asked, (column, frozenset(values)))
        return Projected(self._build, asked, (*self._conditions, F.col(column).isin(*values)))

    def filter(self, condition: Column | str) -> Projected:
        return Projected(self._build, self._asked, (*self._conditions, condition))

    @cached_property
    def frame(self) -> DataFrame:
        rows = self._build(self._asked)
        for condition in self._conditions:
            rows = rows.filter(condition)
        return rows

    def __getattr__(self, name: str):
        return getattr(self.frame, name)


def only(rows: DataFrame | Projected, column: str, *values: str) -> DataFrame | Projected:
    """Rows whose column is one of the values."""
    return rows.only(column, *values) if isinstance(rows, Projected) else rows.filter(F.col(column).isin(*values))
