"""The rule engine over flow tables: from facts to ordered cases, kinds and chosen asks.

Every table has a ``repo`` column; all work is per repo, so many repos run side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.cost import density, input_tokens, output_tokens, short, weighted
from ledgerlens.functions.text import any_of, any_within, directory, snake, target_file, test_name
from ledgerlens.operators import graph, joins
from ledgerlens.operators.predicates import exists_per, first_allowed, first_reason, runnable
from ledgerlens.operators.ranking import best, case_order, first_fit_split, lifecycle_score
from ledgerlens.operators.rollups import margin, scores
from ledgerlens.plans import dims
from ledgerlens.sources.shared import checkpointed


def profile(flows: DataFrame, entries: DataFrame, nodes: DataFrame, seams: DataFrame, machines: DataFrame, facts: DataFrame) -> DataFrame:
    """A row for each repo: what its rules can ask about."""
    of_nodes = exists_per(nodes, ["repo"], any_money=F.col("handles_money"), any_tx=F.col("opens_tx"), any_goroutine=F.col("spawns_goroutine"))
    of_seams = seams.groupBy("repo").agg(F.collect_set("kind").alias("kinds"), F.coalesce(F.bool_or("injectable"), F.lit(False)).alias("any_injectable"))
    counts = entries.groupBy("repo").agg(F.count(F.lit(1)).alias("n_entries"))
    states = machines.groupBy("repo").agg(F.count(F.lit(1)).alias("n_machines"))
    out = flows
    for part in (of_nodes, of_seams, counts, states, facts):
        out = out.join(part, "repo", "left")
    no = F.lit(False)
    empty = F.array().cast("array<string>")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select(
        "repo", F.coalesce("tenant_scheme", no).alias("tenant_scheme"), F.coalesce("hash_chains", F.lit(0)).alias("hash_chains"), F.coalesce("patterns", empty).alias("patterns"),
        F.coalesce("skipped", F.create_map().cast("map<string,string>")).alias("skipped"),
        *[F.coalesce(c, no).alias(c) for c in ("any_money", "any_tx", "any_goroutine", "any_injectable", "known")],
        F.coalesce("kinds", empty).alias("kinds"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("n_machines", F.lit(0)).alias("n_machines"),
        *[blank(c) for c in ("money_type", "balance_func", "transfer_func", "idempotency_key")],
    )


def blocked() -> Column:
    """Why a scenario does not apply to a repo: the first of the checks that fails; null if it applies.

    Whether some seam has a kind and whether some seam can be replaced are asked apart.
    """
    need = lambda name: F.array_contains("requires", name)
    lack = lambda c: F.col(c) == ""
    known = F.col("known")
    seam_kinds = F.array_join(F.array_sort("seam_kinds"), " or ")
    patterns = F.array_join(F.array_sort("write_patterns"), " or ")
    return first_reason([
        (F.col("skipped")[F.col("scenario")].isNotNull(), F.concat(F.lit("skipped by rule: "), F.col("skipped")[F.col("scenario")])),
        (known & need("balance") & lack("balance_func"), "no balance function"),
        (known & need("transfer") & lack("transfer_func"), "no transfer function"),
        (known & need("key") & lack("idempotency_key"), "no idempotency key"),
        (known & need("money") & lack("money_type") & lack("transfer_func"), "no money type and no transfer function"),
        (need("machine") & (F.col("n_machines") == 0), "no state machine"),
        (need("entries") & (F.col("n_entries") < 2), "fewer than two entries"),
        (need("money") & ~known & ~F.col("any_money"), "no money in reach"),
        (need("tx") & ~F.col("any_tx"), "no transaction"),
        (need("goroutine") & ~F.col("any_goroutine"), "no goroutine"),
        ((F.size("seam_kinds") > 0) & ~F.arrays_overlap("seam_kinds", "kinds"), F.concat(F.lit("no boundary of kind "), seam_kinds)),
        ((F.size("write_patterns") > 0) & ~F.arrays_overlap("write_patterns", "patterns"), F.concat(F.lit("no table written by "), patterns)),
        (need("injectable") & ~F.col("any_injectable"), "no replaceable boundary"),
        (need("tenant") & ~F.col("tenant_scheme"), "no tenant column"),
        (need("hash_chain") & (F.col("hash_chains") == 0), "no hash chain"),
    ])


def cases(profiles: DataFrame) -> DataFrame:
    """Every scenario of the catalogue for every repo: blocked with its reason, or with its technique and size.

    The catalogue is a fixed table of 34 rows, so it is broadcast and each profile meets all of it.
    """
    catalogue = F.broadcast(dims.scenarios(profiles.sparkSession))
    met = profiles.withColumn("_one", F.lit(1)).join(catalogue.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn("blocked", blocked())
    barred = F.when(F.col("any_injectable"), F.array().cast("array<string>")).otherwise(F.array(F.lit("faultInjection")))
    chosen = met.withColumn("technique", F.when(F.col("blocked").isNull(), first_allowed(F.col("techniques"), barred)))
    chosen = chosen.withColumn("blocked", F.when(F.col("blocked").isNull() & F.col("technique").isNull(), "no technique is possible").otherwise(F.col("blocked")))
    medium = F.array_contains("requires", "database") | F.col("technique").isin(dims.MEDIUM_TECHNIQUES)
    return chosen.select("repo", "ord", "scenario", "family", "severity", "oracle", "technique", F.when(F.col("technique").isNotNull(), F.when(medium, "medium").otherwise("small")).alias("size"), "blocked", "requires", "seam_kinds")


def candidate_pools(runnable: DataFrame) -> DataFrame:
    """runnable cases with pool, the number of the set of seams from which a case takes its own; null for none.

    A case that names kinds takes the seams of these, kind by kind; another one that needs a
    replaceable seam takes those. Cases with the same candidates share a pool.
    """
    named = F.array_join("seam_kinds", " ")
    pool = F.lit(None).cast("int")
    for k, kinds in enumerate(dims.seam_pools(), 1):
        pool = F.when(named == kinds, k).otherwise(pool)
    return runnable.withColumn("pool", F.when(F.size("seam_kinds") > 0, pool).when(F.array_contains("requires", "injectable"), 0))


def selected(flow: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The complete cases of every repo, in order, and for each runnable one its seams and entries.

    flow: flows, entries (repo, ord, pkg, symbol), nodes (repo, id, file and their traits), edges (repo, src, dst), seams (repo, ord,
    kind, target, in_id, injectable), machines (repo, ord, type, states), roles (repo, type, roles), facts.

    A seam belongs to the first entry that reaches its node (one label a node), and of the
    seams of one target only the first counts. The entries of a case are those from which some of its seams is
    reached, found backward; a case without seams has the first entry. Both walks go over pools of candidates,
    not over cases. cases has counts and the first entry's place; seams and entries have a row each.
    """
    entries, seams = flow["entries"], flow["seams"]
    every = checkpointed(case_order(cases(profile(*[flow[k] for k in ("flows", "entries", "nodes", "seams", "machines", "facts")]))))  # a row for each repo and scenario
    runnable_cases = checkpointed(candidate_pools(every.where(runnable(F.col("blocked"))).select("repo", "scenario", "seam_kinds", "requires")).select("repo", "scenario", "pool", "seam_kinds"))
    pools = runnable_cases.where("pool is not null").select("repo", "pool", "seam_kinds").distinct()
    by_kind = pools.where("pool > 0").select("repo", "pool", F.posexplode("seam_kinds").alias("kind_place", "kind")).join(seams, ["repo", "kind"])
    by_trait = pools.where("pool = 0").select("repo", "pool", F.lit(0).alias("kind_place")).join(seams.where("injectable"), "repo")
    candidates = by_kind.unionByName(by_trait.select(*by_kind.columns))
    labels = graph.least_entry(flow["edges"], flow["nodes"], entries)
    own = checkpointed(joins.scoped(candidates, labels, ("pool",), ("kind_place", "ord")))
    case_seams = runnable_cases.join(own.select("repo", "pool", "target", "in_id", "kind", "ord"), ["repo", "pool"]).select("repo", "scenario", "target", "in_id", "kind", "ord")

    met = joins.touching(flow["edges"], entries, own)
    with_seams = own.select("repo", "pool").distinct()
    none = runnable_cases.join(with_seams, ["repo", "pool"], "left_anti").select("repo", "scenario")
    first = entries.groupBy("repo").agg(F.min("ord").alias("entry_ord"))
    case_entries = runnable_cases.join(met, ["repo", "pool"]).select("repo", "scenario", "entry_ord").unionByName(none.join(first, "repo").select("repo", "scenario", "entry_ord"))
    case_entries = checkpointed(case_entries)

    of_seams = case_seams.groupBy("repo", "scenario").agg(F.count(F.lit(1)).alias("n_seams"))
    of_entries = case_entries.groupBy("repo", "scenario").agg(F.count(F.lit(1)).alias("n_entries"), F.min("entry_ord").alias("ord"))
    places = entries.select("repo", "ord", F.col("pkg").alias("target_pkg"), F.concat_ws("#", "pkg", "symbol").alias("id")).join(flow["nodes"].select("repo", "id", directory(F.col("file")).alias("dir")), ["repo", "id"], "left")
    at = of_entries.join(places.drop("id"), ["repo", "ord"]).drop("ord")
    machine = best_machine(flow["machines"], flow["roles"]).select("repo", F.col("type").alias("machine"))
    named = flow["flows"].select("repo", "tenancy", "first_chain")
    whole = every.join(of_seams, ["repo", "scenario"], "left").join(at, ["repo", "scenario"], "left").join(machine, "repo", "left").join(named, "repo", "left")
    on = runnable(F.col("blocked"))
    need = lambda name, c: F.when(on & F.array_contains("requires", name), F.col(c))
    return {
        "cases": whole.select(
            "repo", "ord", "scenario", test_name(F.col("scenario")).alias("func_name"), "family", "severity", "technique", "size", "blocked", "requires", on.alias("runnable"),
            F.coalesce("n_seams", F.lit(0)).alias("n_seams"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), need("machine", "machine").alias("machine"), need("tenant", "tenancy").alias("tenancy"), need("hash_chain", "first_chain").alias("hash_chain"),
            F.when(on, F.coalesce("target_pkg", F.lit(""))).alias("target_pkg"), F.when(on, target_file(F.coalesce("dir", F.lit("")), F.col("family"), F.col("size"))).alias("target_file"), "place",
        ),
        "seams": case_seams,
        "entries": case_entries,
    }


def signal(test: str, atom: Callable[[str, tuple[str, ...]], Column], currencies: Column) -> Column:
    """A test of the signal table as a condition, of atoms: a sort of name and the words of which any is meant."""

    def one(part: str) -> Column:
        part = part.strip()
        if part == "currencies":
            return currencies > 1
        kind, _, names = part.lstrip("!").partition(":")
        found = atom(kind, tuple(names.split()))
        return ~found if part.startswith("!") else found

    return reduce(Column.__or__, [reduce(Column.__and__, [one(p) for p in alternative.split("&")]) for alternative in test.split(" or ")])


def on_arrays(kind: str, words: tuple[str, ...]) -> Column:
    """An atom on gathered facts: arrays of names, and a text of all symbols."""
    if kind == "table":
        # A field named like a table counts, also without a last s.
        return any_of(F.col("tables"), list(words)) | any_of(F.col("fields"), list(words), singular=True)
    if kind == "column":
        return any_of(F.col("columns"), list(words)) | any_of(F.col("fields"), list(words))
    if kind == "state":
        return F.exists("states", lambda s: any_within(s, list(words)))
    return any_within(F.col("symbols"), list(words))


def on_rows(kind: str, words: tuple[str, ...]) -> Column:
    """The same atom on one row (sort, value): whether that row alone meets it."""
    sort, value = F.col("sort"), F.col("value")
    if kind == "table":
        return ((sort == "table") & value.isin(*words)) | ((sort == "field") & any_of(F.array(value), list(words), singular=True))
    if kind == "column":
        return sort.isin("column", "field") & value.isin(*words)
    return (sort == ("state" if kind == "state" else "symbol")) & any_within(value, list(words))


def facts_as_rows(tables: DataFrame, columns: DataFrame, fields: DataFrame, symbols: DataFrame, states: DataFrame, checks: DataFrame) -> DataFrame:
    """repo, sort, value: the names of a flow, a row each, in the case in which signals look for them."""
    named = fields.where("field <> ''")
    parts = [
        tables.select("repo", F.lit("table").alias("sort"), F.lower("table").alias("value")), columns.select("repo", F.lit("column").alias("sort"), F.lower("column").alias("value")),
        named.select("repo", F.lit("field").alias("sort"), F.lower("field").alias("value")), named.select("repo", F.lit("field").alias("sort"), F.lower(snake(F.col("field"))).alias("value")),
        symbols.select("repo", F.lit("symbol").alias("sort"), F.lower("symbol").alias("value")), states.select("repo", F.lit("state").alias("sort"), F.upper("state").alias("value")),
        checks.where((F.octet_length("value") == 3) & (F.col("value") == F.upper("value"))).select("repo", F.lit("currency").alias("sort"), "value"),
    ]
    return reduce(DataFrame.unionByName, parts)


def classified(facts: DataFrame, machines: DataFrame) -> DataFrame:
    """kinds_of over gathered facts (arrays of names, a text of symbols)."""
    return kinds_of(facts, machines, lambda test: signal(test, on_arrays, F.col("currencies")))


def classified_rows(rows: DataFrame, machines: DataFrame, every: DataFrame) -> DataFrame:
    """kinds_of over facts_as_rows, for the repos in every: what a repo's names meet is told by flags, so nothing of them is gathered."""
    atoms: dict[tuple[str, tuple[str, ...]], str] = {}
    for *_, test in dims.rows(dims.SIGNALS):
        signal(test, lambda kind, words: F.col(atoms.setdefault((kind, words), f"a{len(atoms)}")), F.lit(0))
    met = [F.bool_or(on_rows(*atom)).alias(name) for atom, name in atoms.items()]
    flags = rows.groupBy("repo").agg(*met, F.count_distinct(F.when(F.col("sort") == "currency", F.col("value"))).alias("currencies"))
    whole = every.select("repo").distinct().join(flags, "repo", "left").select("repo", *[F.coalesce(n, F.lit(False)).alias(n) for n in atoms.values()], F.coalesce("currencies", F.lit(0)).alias("currencies"))
    return kinds_of(whole, machines, lambda test: signal(test, lambda kind, words: F.col(atoms[kind, words]), F.col("currencies")))


def kinds_of(facts: DataFrame, machines: DataFrame, met: Callable[[str], Column]) -> DataFrame:
    """Per repo: its spine and whether that is unsure, its motions (score 4 or more; by score, then name) and its overlays."""
    rules = [(f"{axis} {kind}", int(weight), test, met(test)) for axis, kind, weight, test in dims.rows(dims.SIGNALS)]
    scored = scores(facts, ["repo"], rules).select("repo", F.substring_index("type", " ", 1).alias("axis"), F.substring_index("type", " ", -1).alias("kind"), "score")
    of = lambda axis, least: F.transform(F.array_sort(F.collect_list(F.when((F.col("axis") == axis) & (F.col("score") >= least), F.struct(-F.col("score"), "kind")))), lambda x: x["kind"])
    point = lambda kind: F.coalesce(F.sum(F.when((F.col("axis") == "spine") & (F.col("kind") == kind), F.col("score"))), F.lit(0))
    grouped = scored.groupBy("repo").agg(point("double_entry").alias("double_entry"), point("wallet").alias("wallet"), of("motion", 4).alias("motions"), of("overlay", 1).alias("overlays"))
    every = facts.select("repo").join(grouped, "repo", "left").join(machines.select("repo").distinct().withColumn("stateful", F.lit(True)), "repo", "left")
    zero, empty = F.lit(0), F.array().cast("array<string>")
    spine, unsure = margin(F.coalesce("double_entry", zero), F.coalesce("wallet", zero), ("double_entry", "wallet", "stateless"))
    motions = F.coalesce("motions", empty)
    motions = F.when((F.size(motions) == 0) & F.col("stateful"), F.array(F.lit("one_shot"))).otherwise(motions)
    return every.select("repo", spine.alias("spine"), unsure.alias("unsure"), motions.alias("motions"), F.coalesce("overlays", empty).alias("overlays"))


def decided(asks: DataFrame, demands: DataFrame, by_seam: DataFrame, by_state: DataFrame) -> DataFrame:
    """Whether and how each ask is put, what it costs and what it is worth.

    Kinds without registered fields are kept, at the price of one open field whatever they say of
    their output; those that no runnable scenario needs are skipped. input and output are what is
    paid, 0 for what is skipped; asked_input and asked_output are the price of asking for all fields openly.
    """
    fields = F.broadcast(dims.answer_fields(asks.sparkSession).groupBy(F.substring_index("path", ".", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n_fields"), F.count_if(F.col("use") == "live").alias("n_live")))
    joined = asks.join(fields, "kind", "left").join(demands.select("repo", "runnable", "money", "main_entity"), "repo", "left")
    joined = joined.join(by_seam.select("repo", F.col("target").alias("subject"), F.size("scenarios").alias("seam_worth")), ["repo", "subject"], "left")
    joined = joined.join(by_state.select("repo", F.col("machine").alias("subject"), F.size("scenarios").alias("state_worth")), ["repo", "subject"], "left")
    kind, no = F.col("kind"), F.lit(False)
    registered = F.col("n_fields").isNotNull()
    why = F.when(~registered, "not registered").when(F.col("n_live") == 0, "nothing reads it")
    why = why.when((kind == "externalEffect") & F.col("seam_worth").isNull(), "seam not in demand").when((kind == "stateRoles") & F.col("state_worth").isNull(), "machine not in demand")
    why = why.when((kind == "moneyModel") & ~F.coalesce("money", no), "money model not in demand").when((kind == "mainEntity") & ~F.coalesce("main_entity", no), "key not in demand")
    skip = registered & why.isNotNull()
    method = F.when(skip, "skip").when(registered & ((kind == "externalEffect") | ((kind == "moneyModel") & F.col("settled"))), "verify").otherwise("open")
    value = F.when(kind == "externalEffect", F.col("seam_worth")).when(kind == "stateRoles", F.col("state_worth")).when(kind.isin("moneyModel", "mainEntity"), F.col("runnable"))
    value = F.when(skip, 1).otherwise(F.coalesce(value, F.lit(1))).cast("long")
    n = F.when(~registered, 1).when(F.col("asks") < 1, F.col("n_fields")).otherwise(F.col("asks"))
    out = joined.withColumn("why", F.coalesce(why, F.concat(F.col("n_live"), F.lit(" fields read")))).withColumn("method", method).withColumn("chosen", ~skip).withColumn("value", value)
    own = F.when(registered & (F.col("output") > 0), F.col("output").cast("long")).otherwise(output_tokens(kind, F.col("method"), n))
    asked = input_tokens(F.col("prompt"))
    priced = out.withColumn("input", F.when(F.col("chosen"), asked).otherwise(0)).withColumn("out_tokens", F.when(F.col("chosen"), own).otherwise(0))
    trim = F.when(F.col("chosen") & (F.col("output") == 0) & (n > F.col("n_live")), output_tokens(kind, F.col("method"), n - F.col("n_live"))).otherwise(0)
    cost = weighted(F.col("input"), F.col("out_tokens"))
    return priced.select(
        "repo", "ord", "kind", "subject", "method", "why", "chosen", "value", "input", F.col("out_tokens").alias("output"), trim.alias("trimmable"), cost.alias("weighted"), density(F.col("value"), cost).alias("rank"),
        asked.alias("asked_input"), output_tokens(kind, F.lit("open"), F.coalesce("n_fields", F.lit(0))).alias("asked_output"),
    )


def planned(choices: DataFrame, budgets: DataFrame) -> DataFrame:
    """The choices of decided with place, within the budget (repo, budget) of their repo; 0 or none is no limit.

    Chosen asks come first, by worth for their weight, then as they stand. First-fit takes them in
    that order; one that overflows stays as skipped, keeping its price, and later ones may still fit. The asks of
    one repo are spread over tasks.
    """
    ranked = choices.join(budgets.select("repo", F.coalesce("budget", F.lit(0)).cast("long").alias("budget")), "repo", "left")
    keyed = ranked.withColumn("_after", (~F.col("chosen")).cast("int")).withColumn("_worth", -F.col("rank"))
    counted = F.when(F.col("chosen"), F.col("weighted")).otherwise(0)
    fit = first_fit_split(keyed.withColumn("_weight", counted), ["repo"], ["_after", "_worth", "ord"], "_weight", F.coalesce("budget", F.lit(0)))
    over = F.col("chosen") & ~F.col("taken")
    why = F.concat(F.lit("over the budget of "), short(F.col("budget")), F.lit(", of which "), short(F.col("spent")), F.lit(" is spent"))
    out = fit.withColumn("why", F.when(over, why).otherwise(F.col("why"))).withColumn("method", F.when(over, "skip").otherwise(F.col("method"))).withColumn("chosen", F.col("chosen") & F.col("taken"))
    return out.drop("_after", "_worth", "_weight", "taken", "spent", "budget")


def best_machine(machines: DataFrame, roles: DataFrame) -> DataFrame:
    """Per repo the machine (repo, ord, type, states) to test: of those with two states or more the one with the
    greatest lifecycle score of its roles (repo, type, roles), the first on ties."""
    scored = machines.where(F.size("states") >= 2).join(roles, ["repo", "type"], "left").withColumn("lifecycle", lifecycle_score(F.col("roles")))
    return best(scored, ["repo"], F.col("lifecycle"), "ord", "type")


def in_round_two(cases: DataFrame) -> DataFrame:
    """The asks of the second round: one for each runnable case, in their order."""
    return cases.where(runnable(F.col("blocked"))).select("repo", F.lit("testCase").alias("kind"), F.col("scenario").alias("subject"), "technique", "size", F.row_number().over(Window.partitionBy("repo").orderBy("place")).alias("ord"))
