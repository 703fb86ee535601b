"""Checks of answers: each gives the array of what is wrong, empty if nothing is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
REPRESENTATIONS = ["minor_units_int", "decimal", "float", "unknown"]
UNIQUENESS = ["db_constraint", "app_check_then_write", "none", "unknown"]
PLACEHOLDERS = ["todo", "tbd", "n/a", "unknown", "..."]
PLACEHOLDER_PACKAGE = "example.com/pay/"


def problems(*checks: tuple[Column, str]) -> Column:
    """The messages of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in checks]))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def placeholder(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(PLACEHOLDERS) | c.startswith(PLACEHOLDER_PACKAGE)


def outside(items: Column, declared: Column) -> Column:
    """Whether an array holds what is not declared."""
    return F.size(F.array_except(items, declared)) > 0


def money_model(representation: Column, uniqueness: Column, type_name: Column, proof: Column, transfer: Column | None = None, transfer_proof: Column | None = None) -> Column:
    checks = [
        (~F.coalesce(representation, F.lit("")).isin("", *REPRESENTATIONS), "unknown representation"),
        (~F.coalesce(uniqueness, F.lit("")).isin("", *UNIQUENESS), "unknown uniqueness"),
        (~blank(type_name) & blank(proof), "a type without proof"),
    ]
    if transfer is not None:
        checks.append((~blank(transfer) & blank(transfer_proof), "a transfer function without proof"))
    named = placeholder(type_name) if transfer is None else F.coalesce(placeholder(type_name), F.lit(False)) | F.coalesce(placeholder(transfer), F.lit(False))
    return problems(*checks, (named, "a placeholder for a name"))


def main_entity(struct: Column, proof: Column, key: Column, key_proof: Column, no_key_reason: Column, supplied_by: Column, others: Column) -> Column:
    """others: array of (field, purpose, could_be_key, cited)."""
    named = ~blank(key)
    return problems(
        (blank(struct), "no entity"),
        (~blank(struct) & blank(proof), "an entity without proof"),
        (~named & blank(no_key_reason), "neither a key nor a reason for having none"),
        (named & blank(key_proof), "a key without proof"),
        (named & ~blank(key_proof) & (supplied_by == "generated"), "a generated key cannot be retried with"),
        (named & F.exists(others, lambda o: (F.lower(o["field"]) == F.lower(key)) & ~o["could_be_key"]), "the key is also listed as no key"),
        (F.exists(others, lambda o: blank(o["field"])), "an identifier without a name"),
        (F.exists(others, lambda o: ~blank(o["field"]) & blank(o["purpose"])), "an identifier without a purpose"),
        (F.exists(others, lambda o: ~blank(o["field"]) & ~blank(o["purpose"]) & ~o["cited"]), "an identifier without a citation"),
    )


def transitions(states: Column, moves: Column, initial: Column, finals: Column, exceptions: Column) -> Column:
    """moves: map of a state to those it may become; exceptions: array of (src, dst, why)."""
    exits = lambda f: F.coalesce(F.size(F.try_element_at(moves, f)), F.lit(0)) > 0
    return problems(
        (outside(states, F.map_keys(moves)), "a state is not covered"),
        (outside(F.map_keys(moves), states), "an undeclared source"),
        (outside(F.flatten(F.map_values(moves)), states), "an undeclared target"),
        (~blank(initial) & ~F.array_contains(states, initial), "an undeclared initial state"),
        (outside(finals, states), "an undeclared final state"),
        (F.exists(finals, lambda f: exits(f) & ~F.exists(exceptions, lambda e: e["src"] == f)), "a final state with exits"),
        (F.exists(exceptions, lambda e: ~F.array_contains(states, e["src"]) | ~F.array_contains(states, e["dst"])), "an exception of an undeclared state"),
        (F.exists(exceptions, lambda e: blank(e["why"])), "an exception without a reason"),
    )


def state_roles(states: Column, answered: Column, retry_targets: Column, exceptions: Column) -> Column:
    """answered: the states of the roles as they came; exceptions: array of (src, dst, why)."""
    declared = lambda e: F.array_contains(states, e["src"]) & F.array_contains(states, e["dst"])
    own = F.filter(answered, lambda s: F.array_contains(states, s))
    return problems(
        (outside(answered, states), "an undeclared state"),
        (F.size(own) != F.size(F.array_distinct(own)), "a state is answered twice"),
        (outside(retry_targets, states), "a retry enters an undeclared state"),
        (outside(states, answered), "a declared state is missing"),
        (F.exists(exceptions, lambda e: ~declared(e)), "an exception of an undeclared state"),
        (F.exists(exceptions, lambda e: declared(e) & (F.coalesce(e["why"], F.lit("")) == "")), "an exception without a reason"),
    )


def case_answer(status: Column, reason: Column, content: Column, file: Column, assertions: Column, size: Column) -> Column:
    """A blocked case is only asked for its reason, an empty one only for its content."""
    full = (status == "written") & ~blank(content)
    return problems(
        ((status == "blocked") & blank(reason), "blocked without a reason"),
        (~F.coalesce(status, F.lit("")).isin("blocked", "written"), "unknown status"),
        ((status == "written") & blank(content), "written without content"),
        (full & ~F.coalesce(file, F.lit("")).endswith("_test.go"), "not a test file"),
        (full & (F.coalesce(assertions, F.lit(0)) < 1), "no assertion"),
        (full & (size != "small") & ~content.contains("//go:build integration"), "no build tag"),
    )


def question_answer(true_or_false: Column, verdict: Column, info: Column, recheck: Column) -> Column:
    """At most one thing is wrong with an answer: the first that is."""
    return F.slice(problems(
        (true_or_false & verdict.isNull() & blank(info), "no verdict and no reason for it"),
        (recheck & verdict.eqNullSafe(False) & blank(info), "a rejected finding without a reason"),
        (~true_or_false & blank(info), "no answer"),
    ), 1, 1)


def shape_error(found: Column, wanted: Column, show: int = 6) -> Column:
    """Null if any wanted key was found; else the first keys that were."""
    return F.when(~F.arrays_overlap(found, wanted), F.concat(F.lit("found "), F.array_join(F.slice(F.sort_array(found), 1, show), ", ")))


def unsettled_states(roles: DataFrame) -> DataFrame:
    """States answered more than once in a machine."""
    return roles.groupBy("repo", "machine", "state").count().where("count > 1").select("repo", "machine", "state")
