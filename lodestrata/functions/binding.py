"""A name for a value within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once a row, however often `then` or its lambdas use it. An expression that a
    lambda refers to is otherwise worked out for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
