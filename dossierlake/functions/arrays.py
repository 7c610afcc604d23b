"""Turning in-row lists into rows, and naming in-row values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, where `value` is worked out once for a row however often `use` names it, and only if the result is asked for."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rows_of(df: DataFrame, items: Column, position: str, value: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per list item, numbered from 0.

    The outer form plus a filter is used because the inner form makes Catalyst infer
    `size(items) > 0` below it, which evaluates an expensive list twice.
    """
    out = df.select(*keep, F.posexplode_outer(items).alias(position, value))
    return out.filter(F.col(position).isNotNull())
