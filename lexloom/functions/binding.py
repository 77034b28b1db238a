"""Name a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often (and in whatever lambda) it is used.

    The optimizer folds projections into one; a column that is read in a lambda would then be computed anew
    for every element.
    """
    return F.element_at(F.transform(F.array(value), then), 1)
