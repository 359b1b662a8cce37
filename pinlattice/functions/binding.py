"""Evaluate a sub-expression once and use it many times inside one Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside lambdas Spark does not share common sub-expressions, so a parsed
    version used ten times would be parsed ten times. A one-element array makes
    it a lambda variable.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
