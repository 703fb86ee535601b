"""Three-valued answers: true, false and unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(json: Column) -> Column:
    """True or false if the JSON is that literal; null for anything else, the string "true" included."""
    return F.when(F.btrim(json, F.lit(" \t\r\n")).isin("true", "false"), F.from_json(F.concat(F.lit('{"x":'), json, F.lit("}")), "x boolean")["x"])


def is_true(json: Column) -> Column:
    return literal(json).eqNullSafe(True)


def is_false(json: Column) -> Column:
    return literal(json).eqNullSafe(False)


def escapes_rollback(changes: Column, reversible: Column) -> Column:
    """Unless it surely changes nothing or surely is undone."""
    return ~is_false(changes) & ~is_true(reversible)


def mark(verdict: Column, holds_when: Column) -> Column:
    """unknown for no verdict; supports if it is as the evidence wants, else contradicts."""
    return F.when(verdict.isNull(), "unknown").when(verdict == holds_when, "supports").otherwise("contradicts")


def standing(contradicted: Column, unknown: Column) -> Column:
    """A contradiction outranks an unknown mark."""
    return F.when(contradicted, "does not hold").when(unknown, "unsettled").otherwise("holds")


def green(passed: Column) -> Column:
    return passed.eqNullSafe(True)


def red(passed: Column) -> Column:
    return passed.eqNullSafe(False)
