"""Grouped aggregation: demand, standings, scores, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.cost import short, weighted
from ledgerlens.functions.text import snake
from ledgerlens.functions.tristate import mark, standing


#: What a scenario asks for that makes the money model be asked for; a key asks for the main entity as well.
MONEY_NEEDS = ("money", "transfer", "balance", "key")


def demand(cases: DataFrame) -> DataFrame:
    """Per repo: runnable and blocked cases, and of the runnable their scenarios, techniques and what their requirements ask for."""
    on, needs = F.col("runnable"), F.coalesce(F.col("requires"), F.array().cast("array<string>"))
    distinct = lambda c: F.array_sort(F.collect_set(F.when(on, F.col(c))))
    wanted = lambda words: F.coalesce(F.bool_or(on & F.arrays_overlap(needs, F.array(*[F.lit(w) for w in words]))), F.lit(False))
    return cases.groupBy("repo").agg(
        F.count_if(on).alias("runnable"), F.count_if(~on).alias("blocked"), distinct("scenario").alias("scenarios"), distinct("technique").alias("techniques"),
        wanted(MONEY_NEEDS).alias("money"), wanted(("key",)).alias("main_entity"),
    )


def states_demanded(cases: DataFrame, machines: DataFrame) -> DataFrame:
    """repo, machine, scenarios: each machine of two states or more, with the runnable scenarios that need one."""
    need = cases.where(F.col("runnable") & F.array_contains("requires", "machine")).groupBy("repo").agg(F.array_sort(F.collect_set("scenario")).alias("scenarios"))
    return machines.where(F.size("states") >= 2).select("repo", F.col("type").alias("machine")).distinct().join(need, "repo")


def demanded_by(cases: DataFrame, array: str, name: str) -> DataFrame:
    """For each item of an array column, the runnable scenarios that want it."""
    return cases.where("runnable").select("repo", "scenario", F.explode(array).alias(name)).groupBy("repo", name).agg(F.array_sort(F.collect_set("scenario")).alias("scenarios"))


def standings(marks: DataFrame, keys: list[str], mark_column: str = "mark") -> DataFrame:
    """Per group: does not hold at any contradiction, else unsettled at any unknown, else holds."""
    m = F.col(mark_column)
    return marks.groupBy(*keys).agg(standing(F.bool_or(m == "contradicts"), F.bool_or(m == "unknown")).alias("standing"), F.count(F.lit(1)).alias("n_marks"))


def roll_up(evidence: DataFrame, answers: DataFrame) -> DataFrame:
    """The standing of each feature over its answered evidence; features without any are left out. area_ord and ord give their order."""
    marked = evidence.join(answers, "question").withColumn("mark", mark(F.col("verdict"), F.col("holds_when")))
    return standings(marked, ["repo", "area_ord", "ord", "feature"])


def scores(profile: DataFrame, keys: list[str], rules: list[tuple[str, int, str, Column]]) -> DataFrame:
    """Per row and type: the sum of the weights of the rules that hold, and their reasons in order."""
    held = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(t).alias("type"), F.lit(w).alias("weight"), F.lit(k).alias("ord"), F.lit(why).alias("why"))) for k, (t, w, why, c) in enumerate(rules)]))
    hits = profile.select(*keys, F.explode(held).alias("r"))
    return hits.groupBy(*keys, "r.type").agg(F.sum("r.weight").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("r.ord", "r.why"))), lambda x: x["why"]).alias("reasons"))


def margin(one: Column, other: Column, names: tuple[str, str, str], by: int = 2) -> tuple[Column, Column]:
    """The name of the larger score, the other's on a tie, the third for none; and whether it is unsure, being within the margin."""
    first, second, neither = names
    clear = (one >= other + by) | (other >= one + by)
    return F.when((one == 0) & (other == 0), neither).when(one > other, first).otherwise(second), ~clear & ((one > 0) | (other > 0))


def by_count(findings: DataFrame, sites: int = 6) -> DataFrame:
    """Per repo and id: the count, the first title, at most ``sites`` places, and its place, the most frequent first (ties by id)."""
    grouped = findings.groupBy("repo", "id").agg(F.count(F.lit(1)).alias("n"), F.min_by("title", F.struct("ord", "title")).alias("title"), F.min_by("severity", F.struct("ord", "severity")).alias("severity"))
    rank = F.row_number().over(Window.partitionBy("repo", "id").orderBy("ord", "place"))
    shown = findings.withColumn("_rank", rank).where(F.col("_rank") <= sites).groupBy("repo", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "place"))), lambda x: x["place"]).alias("places"))
    return grouped.join(shown, ["repo", "id"]).withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("n"), "id")))


def severities(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "severity").agg(F.count(F.lit(1)).alias("n"))


def first_findings(findings: DataFrame, most: int = 12) -> DataFrame:
    """Per repo the first findings as they stand (place, severity, id, title), and how many more there are."""
    rank = F.row_number().over(Window.partitionBy("repo").orderBy("ord", "id", "place"))
    ranked = findings.withColumn("_rank", rank)
    shown = F.array_sort(F.collect_list(F.when(F.col("_rank") <= most, F.struct("_rank", "severity", "id", "title", "place"))))
    return ranked.groupBy("repo").agg(F.transform(shown, lambda x: x.dropFields("_rank")).alias("findings"), F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("more"))


def seam_summary(seams: DataFrame) -> DataFrame:
    return seams.groupBy("repo").agg(F.count_if("injectable").alias("injectable"), F.count_if(~F.col("injectable")).alias("concrete"))


def proved(seams: DataFrame, findings: DataFrame, machines: DataFrame) -> DataFrame:
    """Per repo the seam and severity counts and the states that are never assigned."""
    by_severity = findings.groupBy("repo").pivot("severity", ["critical", "high", "medium", "info"]).count()
    never = machines.select("repo", F.explode("never_assigned").alias("state")).groupBy("repo").agg(F.array_sort(F.collect_set("state")).alias("never_assigned"))
    return seam_summary(seams).join(by_severity, "repo", "full_outer").join(never, "repo", "full_outer")


def plan_totals(choices: DataFrame, keys: list[str]) -> DataFrame:
    """What the chosen cost, what the others would have if asked, and the share saved in per cent."""
    paid, asked = weighted(F.col("input"), F.col("output")), weighted(F.col("asked_input"), F.col("asked_output"))
    total, avoided = F.coalesce(F.sum(F.when(F.col("chosen"), paid)), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("chosen"), asked)), F.lit(0))
    saved = F.when(total + avoided == 0, F.lit(0.0)).otherwise(100 * avoided / (total + avoided))
    return choices.groupBy(*keys).agg(total.alias("total"), avoided.alias("avoided"), F.bround(saved, 0).cast("long").alias("saved_percent"))


def explained(choices: DataFrame) -> dict[str, DataFrame]:
    """Three views of a plan: the chosen by kind, the skipped by kind and reason, the trimmable by kind. Readers order them."""
    cost = weighted(F.col("input"), F.col("output"))
    by_kind = choices.where("chosen").groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("cost"), F.min_by("why", "ord").alias("why"), F.min_by("method", "ord").alias("method"))
    skipped = choices.where("not chosen").groupBy("repo", "kind", "why").agg(F.count(F.lit(1)).alias("n"))
    trimmable = choices.where("chosen and trimmable > 0").groupBy("repo", "kind").agg(F.sum("trimmable").alias("trimmable"))
    return {"chosen": by_kind.withColumn("shown", short(F.col("cost"))), "skipped": skipped, "trimmable": trimmable}


def batches(items: DataFrame, keys: list[str], kind: str, order: str, item: str) -> DataFrame:
    """For each of the keys one row a kind, in the order in which the kinds are first seen, with its items in order."""
    grouped = items.groupBy(*keys, kind).agg(F.min(order).alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item]).alias("items"))
    return grouped.withColumn("batch", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))


def pack_estimate(asks: DataFrame, preamble: Column) -> DataFrame:
    """Tokens of the prompts with one preamble, and those saved by not repeating it."""
    once = F.octet_length(F.max(preamble))
    n = F.count(F.lit(1))
    return asks.groupBy("repo").agg(F.floor((F.sum(F.octet_length("prompt")) + once) / 4).cast("long").alias("input"), F.when(n > 1, F.floor(once / 4) * (n - 1)).otherwise(F.lit(0)).cast("long").alias("saved"))


def reason_histogram(needs: DataFrame) -> DataFrame:
    return needs.select("repo", F.explode("reasons").alias("reason")).groupBy("repo", "reason").agg(F.count(F.lit(1)).alias("n"))


def fields_of(registry: DataFrame) -> DataFrame:
    """kind, fields, live: the fields of each kind by path, and those that are read."""
    kind = F.substring_index("path", ".", 1)
    return registry.groupBy(kind.alias("kind")).agg(F.array_sort(F.collect_list("path")).alias("fields"), F.array_sort(F.collect_list(F.when(F.col("use") == "live", F.col("path")))).alias("live"))


def failed_names(output: DataFrame, text: str) -> DataFrame:
    """The distinct test names of the failure lines in a text."""
    lines = output.select("repo", F.explode(F.split(text, "\n")).alias("line"))
    names = lines.select("repo", F.regexp_extract("line", r"^\s*--- FAIL: (\S+)", 1).alias("name"))
    return names.where("name <> ''").distinct()


def gathered(tables: DataFrame, columns: DataFrame, fields: DataFrame, symbols: DataFrame, states: DataFrame, checks: DataFrame) -> DataFrame:
    """Per repo: lower-case tables, columns and fields (also in snake case), a blob of symbols, upper-case states, currency-like values.

    tables and columns are those of the tables and of the constraints.
    """
    low = lambda df, c, name: df.groupBy("repo").agg(F.array_sort(F.collect_set(F.lower(c))).alias(name))
    fields = fields.where("field <> ''")
    fields = fields.unionByName(fields.select("repo", snake(F.col("field")).alias("field")))
    blob = symbols.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set(F.lower("symbol"))), " ").alias("symbols"))
    upper = states.groupBy("repo").agg(F.array_sort(F.collect_set(F.upper("state"))).alias("states"))
    # Any value of three bytes that equals its own upper case counts, 123 included.
    money = checks.where((F.octet_length("value") == 3) & (F.col("value") == F.upper("value"))).groupBy("repo").agg(F.count_distinct("value").alias("currencies"))
    out = low(tables, "table", "tables")
    for part in (low(columns, "column", "columns"), low(fields, "field", "fields"), blob, upper, money):
        out = out.join(part, "repo", "full_outer")
    empty = F.array().cast("array<string>")
    return out.select("repo", *[F.coalesce(c, empty).alias(c) for c in ("tables", "columns", "fields", "states")], F.coalesce("symbols", F.lit("")).alias("symbols"), F.coalesce("currencies", F.lit(0)).alias("currencies"))
