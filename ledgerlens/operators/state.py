"""Answers and runs as they come in: last valid one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of old and new, of those with equal keys the last of new, else of old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new")


def applied(state: DataFrame, answers: DataFrame, problems: Column) -> DataFrame:
    """The state with the last valid answer of each kind and subject in place; effects are never checked."""
    good = answers.where((F.col("kind") == "externalEffect") | (F.size(problems) == 0))
    return upserted(state, good.select(*state.columns), ["repo", "kind", "subject"], "ord")


def fed_forward(money: DataFrame, entity: DataFrame) -> DataFrame:
    """The money model with the entity's key, where the model was answered before and has none."""
    joined = money.alias("m").join(entity.select("repo", F.col("key_field").alias("entity_key"), F.col("ord").alias("entity_ord")), "repo", "left")
    takes = (F.coalesce(F.col("idempotency_key"), F.lit("")) == "") & (F.col("ord") < F.col("entity_ord"))
    return joined.withColumn("idempotency_key", F.when(takes, F.col("entity_key")).otherwise(F.col("idempotency_key"))).drop("entity_key", "entity_ord")


def is_final(state: Column, finals: Column, exception_sources: Column) -> Column:
    """Final unless an exception leaves it."""
    return F.array_contains(finals, state) & ~F.array_contains(exception_sources, state)


def round_status(asks: Column, blocked: Column, cases: Column) -> Column:
    return F.when(asks > 0, "round 1").when(F.coalesce(blocked, F.lit("")) != "", "blocked").when(cases > 0, "round 2").otherwise("done")


def gate_report(cases: DataFrame, gate: DataFrame) -> DataFrame:
    """repo, n_cases, refused, missing, more of every repo with cases: whether its second round is refused, and for what."""
    counted = cases.groupBy("repo").agg(F.count(F.lit(1)).alias("n_cases"))
    closed = gate.select("repo", "missing", "more", F.lit(True).alias("_closed"))
    joined = counted.join(closed, "repo", "left")
    return joined.select("repo", "n_cases", F.coalesce("_closed", F.lit(False)).alias("refused"), "missing", "more")


def gated(cases: DataFrame, gate: DataFrame) -> DataFrame:
    """cases of a second round; fails if a repo among them has something missing."""
    checked = cases.join(gate.select("repo", F.lit(True).alias("_closed")), "repo", "left")
    ok = F.assert_true(F.col("_closed").isNull(), F.concat(F.lit("round one is open for "), F.col("repo")))
    return checked.where(ok.isNull()).drop("_closed")


def with_exceptions(derived: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Derived transitions (machine, src, dst) with the allowed exceptions added."""
    return derived.unionByName(exceptions).distinct()
