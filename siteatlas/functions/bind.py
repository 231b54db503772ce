"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A Column that occurs twice in an expression is computed twice inside
    lambdas and after inlining; a lambda variable is not.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


def let_all(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Bind several values at once; ``body`` gets a struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)
