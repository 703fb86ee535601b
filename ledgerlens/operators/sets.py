"""Ordered sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_once(items: Column, item: Column) -> Column:
    return F.array_distinct(F.concat(items, F.array(item)))


def all_kinds(spine: Column, motions: Column, overlays: Column) -> Column:
    return F.concat(F.array(spine), motions, overlays)


def kind_scenarios(kinds: DataFrame, of_kind: DataFrame) -> DataFrame:
    """The distinct scenarios of a repo's kinds."""
    return kinds.join(of_kind, "kind").select("repo", "scenario").distinct()


def missing(expected: Column, have: Column) -> Column:
    return F.array_sort(F.array_except(expected, have))
