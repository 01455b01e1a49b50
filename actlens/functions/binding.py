"""Evaluate a value once inside a larger expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used inside an array lambda may be replaced by its definition when
    the planner moves a filter, and would then be computed for every element. A
    lambda variable is never replaced.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
