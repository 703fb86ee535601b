"""Token costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes a token, the weight of an output token, and output tokens a field by method and by kind.
BYTES_PER_TOKEN = 4
OUTPUT_WEIGHT = 5
VERIFY, NARROW, OPEN = 5, 15, 40
OPEN_BY_KIND = {"externalEffect": 21, "stateRoles": 131, "mainEntity": 128, "moneyModel": 77}


def input_tokens(prompt: Column) -> Column:
    """Bytes, not characters, by four."""
    return F.floor(F.octet_length(prompt) / BYTES_PER_TOKEN).cast("long")


def output_tokens(kind: Column, method: Column, fields: Column) -> Column:
    n = F.greatest(fields, F.lit(1))
    per = F.lit(OPEN)
    for k, v in OPEN_BY_KIND.items():
        per = F.when(kind == k, v).otherwise(per)
    return F.when(method == "skip", 0).when(method == "verify", VERIFY * n).when(method == "narrow", NARROW * n).otherwise(per * n).cast("long")


def weighted(input_: Column, output: Column) -> Column:
    return input_ + output * OUTPUT_WEIGHT


def short(n: Column) -> Column:
    """A count as it is under 1000, else in thousands with one decimal, halves to even."""
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.bround(n.cast("decimal(20,3)") / 1000, 1).cast("decimal(20,1)").cast("string"), F.lit("k")))


def density(value: Column, weight: Column) -> Column:
    """Value for each thousand of weight; 0 for no weight."""
    return F.when(weight == 0, F.lit(0.0)).otherwise(value.cast("double") / weight * 1000)
