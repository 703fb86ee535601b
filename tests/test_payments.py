"""The rule engine on hand-built flows: eligibility, order, scopes, kinds and budgets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import cost, text, tristate
from ledgerlens.operators import graph, joins, predicates, ranking, rollups, sets, state, validation
from ledgerlens.plans import dims, payments

FLOWS = "repo string, tenant_scheme boolean, hash_chains int, patterns array<string>, skipped map<string,string>"
FACTS = "repo string, money_type string, balance_func string, transfer_func string, idempotency_key string, known boolean"
NODES = "repo string, id string, symbol string, handles_money boolean, opens_tx boolean, spawns_goroutine boolean"
SEAMS = "repo string, ord int, in_id string, kind string, target string, injectable boolean"
ENTRIES = "repo string, ord int, pkg string, symbol string"
EDGES = "repo string, src string, dst string, ord int"


def made(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def flow(spark, seams=(("http", True), ("db", False)), known=False, key="", skipped=None, entries=1, machines=1, money=True, transfer=""):
    repo = "r"
    return payments.profile(
        made(spark, [(repo, False, 0, [], skipped or {})], FLOWS),
        made(spark, [(repo, k, "p", f"e{k}") for k in range(entries)], ENTRIES),
        made(spark, [(repo, "p#e0", "e0", money, True, False)], NODES),
        made(spark, [(repo, k, "p#e0", kind, f"t{k}", inj) for k, (kind, inj) in enumerate(seams)], SEAMS),
        made(spark, [(repo, f"M{k}") for k in range(machines)], "repo string, type string"),
        made(spark, [(repo, "", "", transfer, key, known)], FACTS),
    )


def blocked(profile):
    return {r.scenario: r.blocked for r in payments.cases(profile).collect()}


def test_catalogue_has_its_size():
    assert len(dims.rows(dims.SCENARIOS)) == 34
    assert len(dims.rows(dims.FEATURES)) == 24
    assert len(dims.rows(dims.FIELDS)) == 27
    known = {r[0] for r in dims.rows(dims.SCENARIOS)}
    assert all(s in known for *_, ss in dims.rows(dims.KIND_SCENARIOS) for s in ss.split())


def test_existence_is_asked_apart(spark):
    # A queue that cannot be replaced and a database that can: both tests hold, by different seams.
    why = blocked(flow(spark, seams=(("queue", False), ("db", True))))
    assert why["AT-LEAST-ONCE-DELIVERY-IS-SAFE"] is None
    assert why["TIMEOUT-UNKNOWN-OUTCOME"] is None
    assert blocked(flow(spark, seams=(("db", True),)))["TIMEOUT-UNKNOWN-OUTCOME"] == "no boundary of kind http or queue"


def test_order_of_reasons(spark):
    why = blocked(flow(spark, skipped={"IDEM-REPLAY": "not ours"}, known=True))
    assert why["IDEM-REPLAY"] == "skipped by rule: not ours"
    assert why["IDEM-CONCURRENT"] == "no idempotency key"
    assert blocked(flow(spark, known=False))["IDEM-CONCURRENT"] is None


def test_a_real_database_only_changes_the_size(spark):
    rows = {r.scenario: r for r in payments.cases(flow(spark)).collect()}
    assert rows["LOST-UPDATE"].blocked is None and rows["LOST-UPDATE"].size == "medium"
    assert rows["MONEY-ROUND-TRIP-EXACT"].size == "small"


def test_fault_injection_needs_a_replaceable_seam(spark):
    rows = {r.scenario: r for r in payments.cases(flow(spark, seams=(("db", False),), entries=2)).collect()}
    assert rows["RECONCILER-IS-IDEMPOTENT"].technique == "narrowIntegration"
    assert rows["IDEM-CRASH-AT-STEP"].blocked == "no replaceable boundary"


def test_case_order_is_runnable_then_severity_then_catalogue(spark):
    ordered = ranking.case_order(payments.cases(flow(spark))).orderBy("place").collect()
    keys = [(r.blocked is not None, {"critical": 0, "high": 1}[r.severity], r.ord) for r in ordered]
    assert keys == sorted(keys)


EDGE_ROWS = [("r", "p#e0", "a", 0), ("r", "a", "b", 1), ("r", "b", "a", 0), ("r", "p#e1", "b", 0), ("r", "a", "ghost", 0)]


def test_reach_includes_ids_without_a_node_and_itself(spark):
    entries = made(spark, [("r", 0, "p", "e0"), ("r", 1, "p", "e1")], ENTRIES)
    nodes = made(spark, [("r", n, n) for n in ("p#e0", "p#e1", "a", "b")], "repo string, id string, symbol string")
    got = {(r.entry_ord, r.node) for r in graph.reach_sets(nodes, entries, made(spark, EDGE_ROWS, EDGES)).collect()}
    assert got == {(0, "p#e0"), (0, "a"), (0, "b"), (0, "ghost"), (1, "p#e1"), (1, "b"), (1, "a"), (1, "ghost")}
    alone = graph.reach_sets(nodes, entries.where("false"), made(spark, EDGE_ROWS, EDGES))
    assert {r.node for r in alone.collect()} == {"p#e0", "p#e1", "a", "b"}


def test_preorder_meets_each_node_once(spark):
    entries = made(spark, [("r", 0, "p", "e0"), ("r", 1, "p", "e1"), ("r", 2, "p", "none")], ENTRIES)
    nodes = made(spark, [("r", n) for n in ("p#e0", "p#e1", "a", "b")], "repo string, id string")
    rows = graph.preorder(nodes, entries, made(spark, EDGE_ROWS, EDGES)).orderBy("entry_ord", "step").collect()
    assert [(r.entry_ord, r.step, r.depth, r.node) for r in rows] == [(0, 0, 0, "p#e0"), (0, 1, 1, "a"), (0, 2, 2, "b"), (1, 0, 0, "p#e1")]


def test_scope_keeps_the_first_entrys_call_site(spark):
    seams = made(spark, [("r", 0, "b", "http", "x", True), ("r", 1, "a", "http", "x", True), ("r", 2, "far", "db", "y", False)], SEAMS)
    reached = made(spark, [("r", 0, "a"), ("r", 1, "a"), ("r", 1, "b")], "repo string, entry_ord int, node string")
    rows = joins.scoped(seams, reached).collect()
    assert [(r.target, r.in_id, r.entry_ord) for r in rows] == [("x", "a", 0)]
    entries = made(spark, [("r", 0, "p", "e0"), ("r", 1, "p", "e1"), ("s", 3, "p", "e")], ENTRIES)
    kept = joins.under_test(entries, reached, made(spark, [("r", "b")], "repo string, in_id string"))
    assert {(r.repo, r.ord) for r in kept.collect()} == {("r", 1), ("s", 3)}


def test_first_fit_passes_over_and_trim_stops(spark):
    df = made(spark, [("r", 1, 50), ("r", 2, 60), ("r", 3, 40)], "repo string, ord int, w int")
    assert sorted(r.ord for r in ranking.fits(df, ["repo"], ["ord"], "ord", "w", F.lit(100)).collect()) == [1, 3]
    gone = ranking.trimmed(df, ["repo"], [F.desc("w")], "w", F.lit(60)).where("dropped").collect()
    assert sorted(r.ord for r in gone) == [1, 2]


def test_a_contradiction_outranks_an_unknown(spark):
    evidence = dims.evidence(spark)
    answers = made(spark, [("r", "BALANCE-NEVER-NEGATIVE.guard_is_atomic", True), ("r", "LOST-UPDATE.locking", True), ("r", "BALANCE-LIMIT-ENFORCED.checked_atomically", None), ("r", "IDEM-REPLAY.stores_result", True), ("r", "wallet.other_writers", None)], "repo string, question string, verdict boolean")
    got = {r.feature: r.standing for r in rollups.roll_up(evidence, answers).collect()}
    assert got == {"money.balance_guard_is_atomic": "does not hold", "entity.repeat_gets_first_result": "holds", "money.balance_has_one_writer": "unsettled"}


FACTS_SCHEMA = "repo string, tables array<string>, columns array<string>, fields array<string>, states array<string>, symbols string, currencies int"


@pytest.mark.parametrize(
    ("facts", "spine", "motions", "overlays"),
    [
        ((["wallets"], ["balance"], [], [], "creditwallet", 0), "wallet", ["one_shot"], []),
        ((["entries", "accounts"], ["account_type", "debit"], [], [], "", 0), "double_entry", ["one_shot"], []),
        (([], ["phone", "rrn"], [], [], "requery", 0), "stateless", ["topup"], []),
        ((["refunds"], ["currency"], [], [], "", 2), "stateless", ["one_shot"], ["fx_conversion", "refund_reversal"]),
        (([], [], ["wallet"], ["PART_REFUNDED"], "", 0), "wallet", ["one_shot"], ["refund_reversal"]),
        (([], ["auth_code"], [], [], "capture capturelog", 1), "stateless", ["auth_capture"], []),
    ],
)
def test_kinds(spark, facts, spine, motions, overlays):
    row = payments.classified(made(spark, [("r", *facts)], FACTS_SCHEMA), made(spark, [("r",)], "repo string")).first()
    assert (row.spine, row.motions, sorted(row.overlays)) == (spine, motions, overlays)


def test_decisions_follow_demand(spark):
    asks = made(spark, [("r", 0, "externalEffect", "x", "p" * 40, 0, 0, False), ("r", 1, "externalEffect", "y", "p" * 40, 0, 0, False), ("r", 2, "moneyModel", "", "p" * 8, 0, 0, True), ("r", 3, "odd", "", "pppp", 0, 0, False)], "repo string, ord int, kind string, subject string, prompt string, asks int, output int, settled boolean")
    demands = made(spark, [("r", 7, True, False)], "repo string, runnable int, money boolean, main_entity boolean")
    rows = {r.ord: r for r in payments.decided(asks, demands, made(spark, [("r", "x", ["a", "b"])], "repo string, target string, scenarios array<string>"), made(spark, [], "repo string, machine string, scenarios array<string>")).collect()}
    assert (rows[0].method, rows[0].value, rows[0].input, rows[0].output) == ("verify", 2, 10, 25)
    assert not rows[1].chosen and rows[1].method == "skip" and rows[1].weighted == 0
    assert (rows[2].method, rows[2].value) == ("verify", 7)
    assert rows[3].chosen and rows[3].output == 40


def test_own_output_counts_for_registered_kinds_only(spark):
    schema = "repo string, ord int, kind string, subject string, prompt string, asks int, output int, settled boolean"
    asks = made(spark, [("r", 0, "odd", "", "pppp", 0, 999, False), ("r", 1, "questions", "", "pppp", 0, 999, False), ("r", 2, "mainEntity", "", "p" * 40, 0, 0, False)], schema)
    none = lambda name: made(spark, [], f"repo string, {name} string, scenarios array<string>")
    rows = {r.ord: r for r in payments.decided(asks, made(spark, [("r", 7, False, False)], "repo string, runnable int, money boolean, main_entity boolean"), none("target"), none("machine")).collect()}
    assert (rows[0].output, rows[1].output) == (40, 999)
    assert not rows[2].chosen and (rows[2].input, rows[2].output, rows[2].asked_input, rows[2].asked_output) == (0, 0, 10, 8 * 128)


def test_a_plan_keeps_what_it_passes_over(spark):
    schema = "repo string, ord int, kind string, method string, why string, chosen boolean, value long, input long, output long, weighted long, rank double, asked_input long, asked_output long"
    row = lambda ord_, worth, w, chosen=True: ("r", ord_, "k", "open", "read", chosen, worth, w, 0, w, worth / w * 1000, w, 10)
    choices = made(spark, [row(0, 1, 50), row(1, 9, 60), row(2, 1, 40), row(3, 1, 30, chosen=False)], schema)
    plan = lambda budget: {r.ord: r for r in payments.planned(choices, made(spark, [("r", budget)], "repo string, budget int")).collect()}
    got = plan(100)
    assert {k: (r.chosen, r.method, r.place) for k, r in got.items()} == {0: (False, "skip", 3), 1: (True, "open", 1), 2: (True, "open", 2), 3: (False, "open", 4)}
    assert got[0].why == "over the budget of 100, of which 100 is spent" and got[0].weighted == 50
    assert all(r.chosen == (k != 3) for k, r in plan(0).items())
    total = rollups.plan_totals(payments.planned(choices, made(spark, [("r", 100)], "repo string, budget int")), ["repo"]).first()
    assert (total.total, total.avoided, total.saved_percent) == (100, 50 + 30 + 2 * 50, 64)


def test_the_best_known_machine(spark):
    roles = "repo string, type string, roles array<struct<initializing:boolean,final:boolean,foreign:boolean>>"
    machines = made(spark, [("r", 0, "A", ["x"]), ("r", 1, "B", ["x", "y"]), ("r", 2, "C", ["x", "y"]), ("r", 3, "D", ["x", "y"]), ("s", 0, "A", ["x"])], "repo string, ord int, type string, states array<string>")
    known = made(spark, [("r", "A", [(True, False, False), (False, True, False)]), ("r", "C", [(True, False, False)]), ("r", "D", [(False, True, False)])], roles)
    assert [(r.repo, r.type, r.score) for r in payments.best_machine(machines, known).collect()] == [("r", "C", 2)]


def test_tables_by_owner_and_key(spark):
    tables = made(spark, [("r", "ledger_entries", ["id"]), ("r", "Boxes", ["x"]), ("r", "jobs", ["Request_Key"]), ("r", "other", ["x"]), ("r", "kept", [])], "repo string, table string, columns array<string>")
    got = joins.relevant_tables(tables, made(spark, [("r", "kept")], "repo string, table string"), made(spark, [("r", "pkg.LedgerEntry"), ("r", "Box")], "repo string, owner string"), made(spark, [("r", "RequestKey")], "repo string, name string"))
    assert {r.table for r in got.collect() if r.relevant} == {"ledger_entries", "Boxes", "jobs", "kept"}


def test_first_findings(spark):
    findings = made(spark, [("r", k, f"F{k}", "high", "t", "p") for k in range(14)] + [("s", 0, "F", "info", "t", "p")], "repo string, ord int, id string, severity string, title string, place string")
    got = {r.repo: ([x.id for x in r.findings], r.more) for r in rollups.first_findings(findings).collect()}
    assert got == {"r": ([f"F{k}" for k in range(12)], 2), "s": (["F"], 0)}
    assert {(r.repo, r.severity): r.n for r in rollups.severities(findings).collect()} == {("r", "high"): 14, ("s", "info"): 1}


def test_what_was_proved(spark):
    seams = made(spark, [("r", 0, "a", "db", "x", True), ("r", 1, "a", "db", "y", False)], SEAMS)
    findings = made(spark, [("r", "critical"), ("r", "critical"), ("s", "info")], "repo string, severity string")
    machines = made(spark, [("r", ["b", "a"]), ("r", ["a"])], "repo string, never_assigned array<string>")
    got = {r.repo: r for r in rollups.proved(seams, findings, machines).collect()}
    assert (got["r"].injectable, got["r"].concrete, got["r"].critical, got["r"].never_assigned) == (1, 1, 2, ["a", "b"])
    assert got["s"].info == 1 and got["s"].injectable is None


def test_components_of_call_graphs(spark):
    edges = made(spark, [("r", f"n{k:02}", f"n{k + 1:02}", 0) for k in range(30)] + [("r", "z1", "z0", 0), ("s", "n00", "n07", 0)], EDGES)
    got = {(r.repo, r.node): r.component for r in graph.components(edges, ["repo"]).collect()}
    assert got == {**{("r", f"n{k:02}"): "n00" for k in range(31)}, ("r", "z0"): "z0", ("r", "z1"): "z0", ("s", "n00"): "n00", ("s", "n07"): "n00"}


def test_names_and_texts_of_asks(spark):
    assert one(spark, F.array(text.ask_id(F.lit("kind"), F.col("s")), text.ask_id(F.lit("kind"), F.lit(""))), s="a/b c") == ["kind-a-b-c", "kind"]
    assert one(spark, F.array(text.target_file(F.lit("pkg/x"), F.lit("MONEY"), F.col("s"), "_own"), text.target_file(F.lit(""), F.lit("State"), F.lit("medium"))), s="small") == ["pkg/x/money_own_test.go", "./state_integration_test.go"]
    assert one(spark, F.array(text.same_field(F.col("a"), F.lit("AMOUNT")), text.same_field(F.col("a"), F.lit("b"))), a="amount") == [True, False]
    assert one(spark, text.capped(F.col("s"), 4, "!"), s=" abcdef ") == "abcd!" and one(spark, text.capped(F.col("s"), 6), s=" abcdef\n") == "abcdef"
    assert one(spark, text.question_text(F.lit("Pay"), F.col("s"), F.lit(True)), s="Is it?") == "Pay: Is it? Answer true or false."
    assert one(spark, text.question_text(F.lit(None).cast("string"), F.col("s"), F.lit(False)), s="Why?") == "Why? Answer in words."


def test_kinds_have_scenarios_and_exceptions_stay(spark):
    kinds = made(spark, [("r", "topup"), ("r", "voucher"), ("s", "none")], "repo string, kind string")
    got = {(r.repo, r.scenario) for r in sets.kind_scenarios(kinds, dims.kind_scenarios(spark)).collect()}
    assert got == {("r", s) for s in ("TIMEOUT-UNKNOWN-OUTCOME", "IDEM-REPLAY", "FAILURE-IS-NOT-TERMINAL", "FINAL-STATE-IS-FINAL")}
    edge = "machine string, src string, dst string"
    assert {tuple(r) for r in state.with_exceptions(made(spark, [("m", "a", "b")], edge), made(spark, [("m", "b", "a"), ("m", "a", "b")], edge)).collect()} == {("m", "a", "b"), ("m", "b", "a")}


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", bool: "boolean", int: "long", type(None): "string", list: "array<string>"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(values[n])]}" for n in names)).select(column.alias("out")).first().out


@pytest.mark.parametrize(("value", "shown"), [(999, "999"), (1250, "1.2k"), (1350, "1.4k"), (1251, "1.3k"), (123900, "123.9k")])
def test_short_rounds_halves_to_even(spark, value, shown):
    assert one(spark, cost.short(F.col("n")), n=value) == shown


@pytest.mark.parametrize(("json", "true", "false"), [("true", True, False), (" false\n", False, True), ('"true"', False, False), ("1", False, False), ("null", False, False), (None, False, False), ("tru", False, False)])
def test_literals(spark, json, true, false):
    assert one(spark, F.array(tristate.is_true(F.col("j")), tristate.is_false(F.col("j"))), j=json) == [true, false]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.snake, "TraceID", "trace_i_d"), (text.slug, "--A b//C--", "A-b-C"), (text.slug, "x" * 80, "x" * 72), (text.test_name, "IDEM-REPLAY", "TestIdemReplay"),
        (text.first_heading, "a\n## Hi \nb", "Hi"), (text.first_heading, "none", ""), (text.html_escape, 'a"<b>', "a&quot;&lt;b&gt;"), (text.diagram_id, "x/y/pkg#(*T).Fn", "pkg_T_Fn"), (text.diagram_id, "a/b", "a_b"),
        (text.strip_comments, "{\n // a\n \"b\": 1 // c\n}", "{\n\n \"b\": 1 // c\n}"), (text.short_type, "a/b/C", "C"), (text.first_line, "  a\nb", "a"), (text.first_clause, "one, so two", "one"), (text.first_clause, "x" * 60, "x" * 58 + "…"),
        (text.strip_title, "x\n# T\n\nbody", "\nbody"), (text.strip_title, "1\n2\n3\n4\n5\n# T\nb", "1\n2\n3\n4\n5\n# T\nb"), (lambda c: text.indent(c, "  "), "a\nb", "  a\n  b"), (lambda c: text.ellipsis(c, 5), "abcdef", "ab..."), (lambda c: text.ellipsis(c, 7), "äöüß", "äö..."),
        (predicates.representation, "interface{}", "minor_units_int"), (predicates.representation, "big.Rat", "decimal"), (predicates.build_tag, "medium", "integration"),
    ],
)
def test_scalars(spark, f, given, want):
    assert one(spark, f(F.col("s")), s=given) == want


def test_table_names(spark):
    assert one(spark, text.table_names(F.col("s")), s="pkg.Entry") == ["entry", "entrys", "entries"]
    assert one(spark, text.table_names(F.col("s")), s="Box") == ["box", "boxs", "boxes"]


def test_illegal_pairs_hold_self_pairs(spark):
    states = made(spark, [("m", "a"), ("m", "b")], "machine string, state string")
    allowed = made(spark, [("m", "a", "b")], "machine string, src string, dst string")
    unsure = made(spark, [("m", "b", "a")], "machine string, src string, dst string")
    assert {(r.src, r.dst) for r in joins.illegal(states, allowed, unsure).collect()} == {("a", "a"), ("b", "b")}


def test_validations(spark):
    good = validation.question_answer(F.col("t"), F.col("v"), F.col("i"), F.lit(True))
    assert one(spark, good, t=True, v=False, i="") == ["a rejected finding without a reason"]
    assert one(spark, good, t=True, v=True, i="") == []
    none = F.array().cast("array<struct<src:string,dst:string,why:string>>")
    roles = validation.state_roles(F.col("s"), F.col("a"), F.array(F.lit("z")), none)
    assert one(spark, roles, s=["a", "b"], a=["a", "a", "c"]) == ["an undeclared state", "a state is answered twice", "a retry enters an undeclared state", "a declared state is missing"]
    why = F.array(F.struct(F.lit("a").alias("src"), F.lit("b").alias("dst"), F.lit(" ").alias("why")))
    moves = F.create_map(F.lit("a"), F.array(F.lit("b"), F.lit("x")), F.lit("b"), F.array(F.lit("a")))
    assert one(spark, validation.transitions(F.col("s"), moves, F.lit("q"), F.array(F.lit("a"), F.lit("b")), why), s=["a", "b"]) == ["an undeclared target", "an undeclared initial state", "a final state with exits", "an exception without a reason"]
    assert one(spark, validation.shape_error(F.col("f"), F.col("w")), f=["b", "a"], w=["x"]) == "found a, b"
    assert one(spark, validation.shape_error(F.col("f"), F.col("w")), f=["b", "a"], w=["a"]) is None
    others = F.transform(F.col("o"), lambda o: F.struct(o.alias("field"), F.lit("lookup").alias("purpose"), F.lit(False).alias("could_be_key"), F.lit(True).alias("cited")))
    entity = validation.main_entity(F.lit("Payment"), F.lit("a.go:1"), F.col("k"), F.lit("a.go:2"), F.lit(""), F.lit("generated"), others)
    assert one(spark, entity, k="id", o=["ID"]) == ["a generated key cannot be retried with", "the key is also listed as no key"]
    assert one(spark, validation.money_model(F.col("r"), F.lit(""), F.lit("example.com/pay/Money"), F.lit("p")), r="") == ["a placeholder for a name"]


def test_upserts_and_gates(spark):
    old = made(spark, [("r", "c1", 1, "red"), ("r", "c2", 2, "red")], "repo string, case_id string, ord int, s string")
    new = made(spark, [("r", "c1", 3, "green"), ("r", "c3", 4, "red")], "repo string, case_id string, ord int, s string")
    got = {r.case_id: r.s for r in state.upserted(old, new, ["repo", "case_id"], "ord").collect()}
    assert got == {"c1": "green", "c2": "red", "c3": "red"}
    cases = made(spark, [("r", "c1")], "repo string, case_id string")
    closed = made(spark, [("r", ["x"])], "repo string, missing array<string>")
    assert state.gated(cases, closed.where("false")).count() == 1
    with pytest.raises(Exception, match="round one is open"):
        state.gated(cases, closed).collect()


def test_fed_forward_only_if_the_model_came_first(spark):
    money = made(spark, [("r", 1, ""), ("s", 5, ""), ("t", 1, "own")], "repo string, ord int, idempotency_key string")
    entity = made(spark, [("r", 2, "k"), ("s", 2, "k"), ("t", 2, "k")], "repo string, ord int, key_field string")
    assert {r.repo: r.idempotency_key for r in state.fed_forward(money, entity).collect()} == {"r": "k", "s": "", "t": "own"}


def test_missing_overlays(spark):
    assert one(spark, sets.missing(F.col("e"), F.col("h")), e=["b", "a", "b"], h=["b"]) == ["a"]
    assert one(spark, sets.append_once(F.col("a"), F.lit("x")), a=["x", "y"]) == ["x", "y"]


def test_diagrams(spark):
    nodes = made(spark, [("r", "p#a", 'a"b'), ("r", "p#b", "b")], "repo string, id string, symbol string")
    edges = made(spark, [("r", "p#a", "p#b", 0), ("r", "p#a", "ghost", 1)], EDGES)
    seams = made(spark, [("r", 0, "p#a", "db", "pg.Pool", False), ("r", 1, "p#a", "db", "pg.Pool", False), ("r", 2, "p#a", "http", "psp", True)], SEAMS)
    lines = graph.flowchart(nodes, edges, seams).first().diagram.split("\n")
    assert lines[0] == "flowchart TD" and len(lines) == 5 and any("&quot;" in x for x in lines) and sum("-.->" in x for x in lines) == 1
    writes = made(spark, [("r", "T", "paid", "p#a"), ("r", "T", "paid", "p#a"), ("r", "T", "<dynamic>", "p#a")], "repo string, type string, to string, in_id string")
    assert graph.state_diagram(writes).first().diagram == "stateDiagram-v2\n  [*] --> paid: a"


def test_lifecycle_scores(spark):
    schema = "roles array<struct<initializing:boolean,final:boolean,foreign:boolean>>"
    rows = spark.createDataFrame([([],), ([(True, False, True)],), ([(True, False, False), (False, True, False)],)], schema)
    assert [r.s for r in rows.select(ranking.lifecycle_score(F.col("roles")).alias("s")).collect()] == [0, 1, 3]


def test_scan_answers_and_failed_names(spark):
    cand = made(spark, [("r", 1, "money", "Amount", "Pay", "int64", True), ("r", 0, "idempotency", "Key", "Pay", "string", True), ("s", 0, "money", "Cents", "W", "float64", True), ("t", 0, "idempotency", "Id", "W", "string", True)], "repo string, ord int, role string, name string, owner string, type string, decided boolean")
    cons = made(spark, [("r", "unique", ["key", "x"])], "repo string, kind string, columns array<string>")
    got = {r.repo: (r.money_type, r.representation, r.idempotency_key, r.uniqueness) for r in predicates.scan_answers(cand, cons, made(spark, [("t",)], "repo string")).collect()}
    assert got == {"r": ("Pay.Amount", "minor_units_int", "Key", "db_constraint"), "s": ("W.Cents", "float", None, None), "t": (None, None, "Id", "app_check_then_write")}
    out = made(spark, [("r", "ok\n--- FAIL: TestA (0.1s)\n    --- FAIL: TestA/x (0s)\n--- FAIL: TestA (0s)")], "repo string, out string")
    assert {r.name for r in rollups.failed_names(out, "out").collect()} == {"TestA", "TestA/x"}


def test_prompts_keep_what_has_no_priority(spark):
    rows = [("r", 1, "a", "x" * 100, 0, 10), ("r", 1, "b", "x" * 50, 2, 10), ("r", 1, "c", "x" * 60, 2, 10), ("r", 1, "d", "x", 1, 10)]
    contexts = made(spark, rows, "repo string, prompt_id int, label string, content string, priority int, fixed int")
    gone = {r.label: r.dropped for r in ranking.trimmed_prompt(contexts, 190).collect()}
    assert gone == {"a": False, "b": False, "c": True, "d": False}
    assert not any(r.dropped for r in ranking.trimmed_prompt(contexts, 1000).collect())


def test_askable_targets(spark):
    seams = made(spark, [("r", 0, "a", "http", "x", True), ("r", 1, "b", "http", "x", True), ("r", 2, "c", "clock", "t", False), ("r", 3, "c", "random", "u", False)], SEAMS)
    assert [r.target for r in predicates.askable_targets(seams).collect()] == ["x"]


def test_conclusions_leave_out_own_answers(spark):
    cases = made(spark, [("r", "c1", "IDEM-REPLAY", "unit"), ("r", "c2", "IDEM-CONCURRENT", "unit")], "repo string, case_id string, scenario string, technique string")
    features = dims.evidence(spark).select("feature", "informs").distinct()
    marks = made(spark, [("r", "entity.repeat_gets_first_result", "IDEM-REPLAY.stores_result", "supports")], "repo string, feature string, question string, mark string")
    got = {(r.case_id, r.feature) for r in joins.case_conclusions(cases, features, marks).collect()}
    assert got == {("c2", "entity.repeat_gets_first_result")}


def test_case_facts_are_left_joined(spark):
    cases = made(spark, [("r", "c1"), ("s", "c2")], "repo string, case_id string")
    money = made(spark, [("r", "Amount")], "repo string, type string")
    rows = {r.case_id: r.money for r in joins.with_facts(cases, {"money": (money, ["repo"])}).collect()}
    assert rows["c1"].type == "Amount" and rows["c2"] is None


def test_gathered_facts(spark):
    two = lambda rows, name: made(spark, rows, f"repo string, {name} string")
    row = rollups.gathered(two([("r", "Wallets")], "table"), two([("r", "Balance")], "column"), two([("r", "RRN")], "field"), two([("r", "GetStatus"), ("r", "Void")], "symbol"), two([("r", "paid")], "state"), two([("r", "USD"), ("r", "123"), ("r", "eur"), ("r", "EURO")], "value")).first()
    assert (row.tables, row.columns, row.fields, row.symbols, row.states, row.currencies) == (["wallets"], ["balance"], ["r_r_n", "rrn"], "getstatus void", ["PAID"], 2)


def test_fields_and_density(spark):
    kinds = {r.kind: r for r in rollups.fields_of(dims.answer_fields(spark)).collect()}
    assert len(kinds["mainEntity"].fields) == 8 and len(kinds["mainEntity"].live) == 5
    assert one(spark, F.array(cost.density(F.col("v"), F.col("w")), cost.density(F.col("v"), F.lit(0))), v=3, w=6) == [500.0, 0.0]


def test_small_predicates(spark):
    assert one(spark, F.array(*[predicates.entity_question(F.lit(n), F.lit(k)) for n, k in ((0, 0), (1, 1), (1, 2), (2, 0))]), x=1) == [False, False, True, True]
    assert one(spark, F.array(predicates.sees_own_answer(F.col("q"), F.lit("IDEM"), F.lit("fuzz")), predicates.can_find_bugs(F.lit("currentBehavior"))), q="technique.fuzz.seed") == [True, False]
    assert one(spark, F.array(tristate.green(F.lit(None).cast("boolean")), tristate.red(F.lit(False))), x=1) == [False, True]
    assert one(spark, F.array(state.is_final(F.lit("a"), F.array(F.lit("a")), F.array(F.lit("b"))), state.is_final(F.lit("a"), F.array(F.lit("a")), F.array(F.lit("a")))), x=1) == [True, False]
    case = validation.case_answer(F.col("s"), F.lit(""), F.lit("//go:build integration"), F.lit("x_test.go"), F.lit(1), F.lit("medium"))
    assert one(spark, case, s="written") == [] and one(spark, case, s="blocked") == ["blocked without a reason"]
