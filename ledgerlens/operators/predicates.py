"""Row predicates and projections that rules are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[Column, Column | str]]) -> Column:
    """The reason of the first rule whose condition holds; null if none does. Null conditions do not hold."""
    return F.coalesce(*[F.when(condition, reason if isinstance(reason, Column) else F.lit(reason)) for condition, reason in rules])


def exists_per(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """For each key, whether some row meets each condition; each on its own, not all by one row."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in conditions.items()])


def first_allowed(choices: Column, barred: Column) -> Column:
    """The first of an array that is not barred; null if none is left."""
    return F.try_element_at(F.array_except(choices, barred), F.lit(1))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)


def labels(named: list[tuple[Column, Column | str]]) -> Column:
    """The labels whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, name if isinstance(name, Column) else F.lit(name)) for c, name in named]))


def column_note(primary: Column, not_null: Column, default: Column) -> Column:
    """Whether a column is a key, must be set by every insert, or has a default."""
    bare = F.coalesce(default, F.lit("")) == ""
    with_default = F.concat(F.lit("default "), default)
    required = F.coalesce(not_null, F.lit(False))
    value = F.when(required & bare, "not null, no default").when(required, F.concat(F.lit("not null, "), with_default)).when(~bare, with_default)
    return F.concat_ws(", ", F.when(primary, "primary key"), value)


def representation(type_name: Column) -> Column:
    """How a type holds money, by what its name contains, in this order; interface{} holds int and so reads as minor units."""
    t = F.lower(type_name)
    return F.when(t.contains("float"), "float").when(t.contains("decimal") | t.contains("big.rat"), "decimal").when(t.contains("int"), "minor_units_int").otherwise("unknown")


def entity_question(entities: Column, ids_of_only: Column) -> Column:
    """Asked unless there is no entity, or one with fewer than two ids."""
    return ~((entities == 0) | ((entities == 1) & (ids_of_only < 2)))


def sees_own_answer(question: Column, scenario: Column, technique: Column) -> Column:
    return question.startswith(F.concat(scenario, F.lit("."))) | question.startswith(F.concat(F.lit("technique."), technique, F.lit(".")))


def build_tag(size: Column) -> Column:
    return F.when(size == "small", "").otherwise("integration")


def can_find_bugs(oracle: Column) -> Column:
    return oracle != "currentBehavior"


def runnable(blocked: Column) -> Column:
    return F.coalesce(blocked, F.lit("")) == ""


def askable_targets(seams: DataFrame) -> DataFrame:
    """The distinct targets of seams other than clocks and random numbers."""
    return seams.where(~F.col("kind").isin("clock", "random")).select("repo", "target").distinct()


def bound_facts(answers: DataFrame, rules: DataFrame) -> DataFrame:
    """Per repo, what rules say, else what was answered; known once either spoke."""
    names = ["money_type", "balance_func", "transfer_func", "idempotency_key", "uniqueness"]
    both = answers.alias("a").join(rules.alias("r"), "repo", "full_outer")
    spoke = F.greatest(*[F.coalesce(F.col(f"{t}.{n}"), F.lit("")) != "" for t in "ar" for n in names])
    return both.select("repo", *[F.coalesce(F.nullif(F.col(f"r.{n}"), F.lit("")), F.col(f"a.{n}")).alias(n) for n in names], spoke.alias("known"))


def facts_from(models: DataFrame, rules: DataFrame) -> DataFrame:
    """known, the five facts and skipped (scenario to reason) of every repo with a money model or rules.

    models has a row for each repo whose model was answered, which makes it known even where it names
    nothing. rules (repo, money_symbols, skip: an array of scenario and why): the first symbol is the transfer
    function, before the model's, and makes the repo known too; a reason that is missing is named so.
    """
    none = F.array().cast("array<struct<scenario:string,why:string>>")
    why = lambda x: F.coalesce(F.nullif(x["why"], F.lit("")), F.lit("no reason given"))
    # The last word on a scenario holds.
    skip = F.aggregate(F.coalesce("skip", none), F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["scenario"]), F.create_map(x["scenario"], why(x))))
    ruled = rules.select("repo", F.coalesce(F.try_element_at("money_symbols", F.lit(1)), F.lit("")).alias("symbol"), (F.coalesce(F.size("money_symbols"), F.lit(0)) > 0).alias("named"), skip.alias("skip"))
    both = models.withColumn("answered", F.lit(True)).join(ruled, "repo", "full_outer")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    no = F.lit(False)
    return both.select(
        "repo", (F.coalesce("answered", no) | F.coalesce("named", no)).alias("known"), text("money_type").alias("money_type"), text("balance_func").alias("balance_func"),
        F.coalesce(F.nullif(text("symbol"), F.lit("")), text("transfer_func")).alias("transfer_func"), text("idempotency_key").alias("idempotency_key"), text("uniqueness").alias("uniqueness"),
        F.coalesce("skip", F.create_map().cast("map<string,string>")).alias("skipped"),
    )


def scan_answers(candidates: DataFrame, constraints: DataFrame, migrated: DataFrame) -> DataFrame:
    """What a scan alone settles: the decided money and key candidates, and how the key is kept unique.

    Without a constraint on the key it is checked before writing if the repo has migrations, else unknown;
    without a decided key nothing is said.
    """
    first = candidates.where("decided").groupBy("repo", "role").agg(F.min_by(F.struct("name", "owner", "type"), "ord").alias("c"))
    money = first.where("role = 'money'").select("repo", F.concat_ws(".", "c.owner", "c.name").alias("money_type"), F.col("c.name").alias("amount_field"), representation(F.col("c.type")).alias("representation"))
    key = first.where("role = 'idempotency'").select("repo", F.col("c.name").alias("idempotency_key"))
    unique = constraints.where("kind in ('unique', 'primary_key')").select("repo", F.explode(F.transform("columns", F.lower)).alias("column")).distinct()
    covered = key.join(unique, (key.repo == unique.repo) & (F.lower("idempotency_key") == F.col("column")), "left").select(key["*"], F.col("column").isNotNull().alias("constrained"))
    known = covered.join(migrated.select("repo").distinct().withColumn("migrated", F.lit(True)), "repo", "left")
    how = F.when(F.col("constrained"), "db_constraint").when(F.col("migrated"), "app_check_then_write").otherwise("unknown")
    return money.join(known.select("repo", "idempotency_key", how.alias("uniqueness")), "repo", "full_outer")
