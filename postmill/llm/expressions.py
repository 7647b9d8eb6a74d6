"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Inside a lambda of a higher-order function an expression is computed again for each element;
    a variable of an outer lambda is not.
    """
    return F.transform(F.array(value), body)[0]
