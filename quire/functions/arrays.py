"""Helpers for higher-order array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(fields: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Evaluate ``fields`` once per row and use them inside lambdas as ``s[name]``.

    A lambda that refers to an outer *expression* re-evaluates it for every
    element; binding it to a lambda variable first evaluates it once.
    """
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(k) for k, c in fields.items()])),
                                    body), 1)


def positional_sum(arr: Column) -> Column:
    """Σ x_i · i with 1-based positions, as BIGINT."""
    weighted = F.transform(arr, lambda x, i: x.cast("bigint") * (i + 1))
    return F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, b: a + b)
