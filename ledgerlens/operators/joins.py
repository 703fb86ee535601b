"""Joins that keep, scope, drop and compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import snake, table_names
from ledgerlens.operators import graph


def first_wins(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row for each key: the first by order, or the last. Each task passes on one row a key; a null orders first, as in a sort."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(rest, F.struct(*order)).alias("_one")).select(*keys, "_one.*").select(*df.columns)


def scoped(seams: DataFrame, reached: DataFrame, pools: tuple[str, ...] = (), order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The seams of reached nodes; of those of one target the first by entry, then by order.

    reached (repo, node, entry_ord) has all entries of a node or only its least. Seams that stand in
    several pools are scoped in each.
    """
    inside = seams.join(reached.select("repo", F.col("node").alias("in_id"), "entry_ord"), ["repo", "in_id"])
    return first_wins(inside, ["repo", *pools, "target"], ["entry_ord", *order])


def under_test(entries: DataFrame, reached: DataFrame, seams: DataFrame) -> DataFrame:
    """The entries that reach a scoped seam; where a repo has none, its first entry."""
    hit = reached.join(seams.select("repo", F.col("in_id").alias("node")), ["repo", "node"], "left_semi").select("repo", F.col("entry_ord").alias("ord")).distinct()
    touching = entries.join(hit, ["repo", "ord"], "left_semi")
    alone = entries.join(touching, "repo", "left_anti")
    return touching.unionByName(first_wins(alone, ["repo"], ["ord"]))


def touching(edges: DataFrame, entries: DataFrame, seams: DataFrame) -> DataFrame:
    """repo, pool, entry_ord: the entries that reach a seam (repo, in_id, pool), found backward from the seams.

    Pools are small numbers; a node has one row for 64 of them, whatever the number of entries.
    """
    back = edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
    starts = graph.entry_nodes(entries)
    met = graph.marked(back, seams.select("repo", F.col("in_id").alias("node"), F.col("pool").alias("mark")).distinct(), only=starts)
    return starts.join(met, ["repo", "node"]).select("repo", F.col("mark").alias("pool"), "entry_ord").distinct()


def relevant_tables(tables: DataFrame, constrained: DataFrame, owners: DataFrame, keys: DataFrame) -> DataFrame:
    """tables (repo, table, columns) with relevant: constrained, named like an owner (a type) in some plural, as it is or
    in lower case, or with a column named like a key in snake case."""
    named = owners.select("repo", F.explode(table_names(F.col("owner"))).alias("table"))
    wanted = constrained.select("repo", F.col("table").alias("_form")).unionByName(named.withColumnRenamed("table", "_form")).distinct()
    forms = tables.select("repo", "table", F.explode(F.array_distinct(F.array("table", F.lower("table")))).alias("_form")).distinct()
    by_name = forms.join(wanted, ["repo", "_form"], "left_semi").select("repo", "table")
    columns = tables.select("repo", "table", F.explode("columns").alias("_column")).select("repo", "table", F.lower("_column").alias("_column")).distinct()
    by_key = columns.join(keys.select("repo", snake(F.col("name")).alias("_column")).distinct(), ["repo", "_column"], "left_semi").select("repo", "table")
    hits = by_name.unionByName(by_key).distinct().withColumn("_hit", F.lit(True))
    return tables.join(hits, ["repo", "table"], "left").withColumn("relevant", F.coalesce("_hit", F.lit(False))).drop("_hit")


def set_differences(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each key that both sides have with a value in common: what only one side has, as sorted arrays."""
    sides = left.select(*keys, value).distinct().withColumn("_l", F.lit(1)).join(right.select(*keys, value).distinct().withColumn("_r", F.lit(1)), [*keys, value], "full_outer")
    only = lambda have, lack: F.array_sort(F.collect_list(F.when(F.col(have).isNotNull() & F.col(lack).isNull(), F.col(value))))
    return sides.groupBy(*keys).agg(only("_l", "_r").alias("only_left"), only("_r", "_l").alias("only_right"), F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("shared")).where("shared > 0")


def needed(sources: DataFrame, answered: DataFrame) -> DataFrame:
    """Questions of all sources (question, reason, ord) without those answered: each once, with its first place and its reasons."""
    open_ = sources.join(answered.select("question").distinct(), "question", "left_anti")
    return open_.groupBy("question").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def illegal(states: DataFrame, allowed: DataFrame, unsure: DataFrame | None = None) -> DataFrame:
    """machine, src, dst: pairs of a machine's states, those of a state with itself included, that are neither allowed nor unsure."""
    pairs = states.select("machine", F.col("state").alias("src")).join(states.select("machine", F.col("state").alias("dst")), "machine")
    out = pairs.join(allowed, ["machine", "src", "dst"], "left_anti")
    return out.join(unsure, ["machine", "src", "dst"], "left_anti") if unsure is not None else out


def gate(demanded: DataFrame, answered: DataFrame, keys: list[str], name: str, show: int = 4) -> DataFrame:
    """What is demanded and not answered: the first few names and how many more; no row if nothing is."""
    missing = demanded.join(answered, [*keys, name], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("all"))
    return missing.select(*keys, F.slice("all", 1, show).alias("missing"), F.greatest(F.size("all") - show, F.lit(0)).cast("long").alias("more"))


def answer_status(asks: DataFrame, answers: DataFrame, key: str, valid: Column) -> DataFrame:
    """asks with status: missing, invalid or answered."""
    joined = asks.join(answers.withColumn("_came", F.lit(True)), key, "left")
    status = F.when(F.col("_came").isNull(), "missing").when(F.coalesce(valid, F.lit(False)), "answered").otherwise("invalid")
    return joined.withColumn("status", status).drop("_came")


def pending(cases: DataFrame, runs: DataFrame, first_only: bool = False) -> DataFrame:
    """Cases without a run, in order; or the first of each repo only."""
    left = cases.join(runs.select("repo", "case_id").distinct(), ["repo", "case_id"], "left_anti")
    return first_wins(left, ["repo"], ["ord"]) if first_only else left


def entities(candidates: DataFrame, carriers: DataFrame, most: int = 4) -> DataFrame:
    """Owners that carry state, with their ids and money fields: at most ``most`` a repo, the weightiest first."""
    own = candidates.join(carriers, ["repo", "owner"])
    grouped = own.groupBy("repo", "owner").agg(
        F.array_sort(F.collect_set(F.when(F.col("role") == "idempotency", F.col("name")))).alias("ids"),
        F.array_sort(F.collect_set(F.when(F.col("role") == "money", F.col("name")))).alias("money"),
        F.count(F.when((F.col("role") == "idempotency") & F.col("declarative"), 1)).alias("declared"),
        F.sum("weight").alias("weight"),
    )
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("weight"), F.desc(F.size("ids")), "owner"))
    return grouped.where("declared > 0").withColumn("rank", rank).where(F.col("rank") <= most)


def chosen_asks(asks: DataFrame, choices: DataFrame) -> DataFrame:
    """The asks that were chosen, with their own order."""
    return asks.join(choices.where("chosen").select("repo", "kind", "subject"), ["repo", "kind", "subject"], "left_semi")


def case_conclusions(cases: DataFrame, features: DataFrame, marks: DataFrame) -> DataFrame:
    """For each case the features that inform its scenario and have a mark that the case does not see as its own answer."""
    informed = features.select("feature", F.explode("informs").alias("scenario")).join(cases.select("repo", "case_id", "scenario", "technique"), "scenario")
    own = F.col("question")
    seen = own.startswith(F.concat(F.col("scenario"), F.lit("."))) | own.startswith(F.concat(F.lit("technique."), F.col("technique"), F.lit(".")))
    return informed.join(marks, ["repo", "feature"]).where(~seen).select("repo", "case_id", "feature").distinct()


def with_facts(cases: DataFrame, facts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """cases with, under each name, the facts found by its keys, as a struct; null where there is none."""
    for name, (df, keys) in facts.items():
        cases = cases.join(df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name)), keys, "left")
    return cases


def lookup_questions(registries: list[DataFrame]) -> DataFrame:
    """The union of registries (id, text, ...); of an id in several the last one's."""
    every = None
    for k, r in enumerate(registries):
        every = r.withColumn("_ord", F.lit(-k)) if every is None else every.unionByName(r.withColumn("_ord", F.lit(-k)))
    return first_wins(every, ["id"], ["_ord", "text"]).drop("_ord")


def steps(nodes: DataFrame, seams: DataFrame, writes: DataFrame) -> DataFrame:
    """nodes with their seams and state writes, each sorted by line."""
    grouped = lambda df, name, of: df.groupBy("repo", F.col("in_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("line", of))).alias(name))
    return nodes.join(grouped(seams, "seams", "target"), ["repo", "id"], "left").join(grouped(writes, "writes", "to"), ["repo", "id"], "left")
