"""Walks over call graphs: labels, marks, condensed graphs and their plans, against plain walks."""

from __future__ import annotations

import itertools
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerlens.operators import graph, joins, ranking, rollups
from ledgerlens.plans import payments
from ledgerlens.sources import files
from ledgerlens.sources.shared import Buckets

EDGES, NODES, ENTRIES = "repo string, src string, dst string", "repo string, id string", "repo string, ord int, pkg string, symbol string"


def walk(edges, start):
    seen, left = {start}, [start]
    while left:
        at = left.pop()
        for s, d in edges:
            if s == at and d not in seen:
                seen.add(d)
                left.append(d)
    return seen


@pytest.fixture(scope="module")
def tangle(spark):
    """Repos with cycles, chains, loops, a callee that is no node, an entry without calls, and one without entries."""
    draw = random.Random(3)
    rows = {"r": {(f"p#{draw.randint(0, 30)}", f"p#{draw.randint(0, 30)}") for _ in range(45)} | {(f"p#{k}", f"p#{k + 1}") for k in range(40, 52)} | {("p#52", "p#40"), ("p#7", "q#out")}, "alone": {("p#0", "p#1"), ("p#1", "p#0")}}
    edges = spark.createDataFrame([(r, s, d) for r, es in rows.items() for s, d in es], EDGES)
    nodes = spark.createDataFrame([("r", f"p#{k}") for k in range(53)] + [("alone", "p#0"), ("alone", "p#1"), ("alone", "p#2")], NODES)
    entries = spark.createDataFrame([("r", k, "p", str(k)) for k in (1, 5, 40, 100)] + [("r", 200, "p", "23")], ENTRIES)
    reach = {o: walk(rows["r"], f"p#{n}") for o, n in ((1, 1), (5, 5), (40, 40), (100, 100), (200, 23))}
    return rows, edges, nodes, entries, reach


def test_reach_sets_are_those_of_plain_walks(tangle):
    _, edges, nodes, entries, reach = tangle
    got = {(r.repo, r.entry_ord, r.node) for r in graph.reach_sets(nodes, entries, edges).collect()}
    assert got == {("r", o, n) for o, ns in reach.items() for n in ns} | {("alone", 0, f"p#{k}") for k in range(3)}


def test_least_labels(tangle):
    _, edges, nodes, entries, reach = tangle
    got = {(r.repo, r.node): r.entry_ord for r in graph.least_entry(edges, nodes, entries).collect()}
    want = {("r", n): min(o for o, ns in reach.items() if n in ns) for ns in reach.values() for n in ns} | {("alone", f"p#{k}"): 0 for k in range(3)}
    assert got == want


def test_labels_scope_seams_as_reach_sets_do(spark, tangle):
    _, edges, nodes, entries, _ = tangle
    draw = random.Random(4)
    seams = spark.createDataFrame([("r", f"t{draw.randint(0, 9)}", k, f"p#{draw.randint(0, 52)}") for k in range(60)] + [("alone", "t", 1, "p#1"), ("alone", "t", 0, "p#2")], "repo string, target string, ord int, in_id string")
    by_labels = joins.scoped(seams, graph.least_entry(edges, nodes, entries)).collect()
    by_sets = joins.scoped(seams, graph.reach_sets(nodes, entries, edges)).collect()
    assert sorted(map(repr, by_labels)) == sorted(map(repr, by_sets)) and len(by_labels) > 5


def test_entries_are_found_backward(spark, tangle):
    _, edges, _, entries, reach = tangle
    seams = [("r", "p#45", 0), ("r", "p#3", 1), ("r", "p#8", 1), ("r", "q#out", 70), ("r", "nowhere", 2)]
    got = {(r.pool, r.entry_ord) for r in joins.touching(edges, entries, spark.createDataFrame(seams, "repo string, in_id string, pool int")).collect()}
    assert got == {(p, o) for _, n, p in seams for o, ns in reach.items() if n in ns}


def test_parts_are_the_strongly_connected_ones(tangle):
    rows, edges, *_ = tangle
    members, between = graph.condensed(edges)
    part = {(r.repo, r.node): r.part for r in members.collect()}
    for repo, es in rows.items():
        names = {n for e in es for n in e}
        reach = {n: walk(es, n) for n in names}
        assert all((part[repo, a] == part[repo, b]) == (b in reach[a] and a in reach[b]) for a in names for b in names)
        assert {(r.src, r.dst) for r in between.where(F.col("repo") == repo).collect()} == {(part[repo, s], part[repo, d]) for s, d in es if part[repo, s] != part[repo, d]}


def test_a_round_shuffles_only_what_it_passes_on(spark, tmp_path):
    source = str(tmp_path / "edges.parquet")
    spark.range(3000).select(F.lit("r").alias("repo"), (F.col("id") % 1000).alias("src"), (F.col("id") * 7 % 1000).alias("dst")).write.parquet(source)
    laid = Buckets(spark.read.parquet(source), ["repo", "src"])
    found = Buckets(spark.range(5).select(F.lit("r").alias("repo"), F.col("id").alias("node"), F.lit(0).alias("value"), F.lit(0).alias("round")), ["repo", "node"], "round")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.step(laid.read(), found.read(), ["repo"], [], F.min, graph._less, lambda v: v, 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "edges.parquet" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan


def test_empty_graphs(spark):
    none = spark.createDataFrame([], EDGES)
    nodes = spark.createDataFrame([("r", "p#1"), ("s", "p#2")], NODES)
    entries = spark.createDataFrame([("r", 3, "p", "1")], ENTRIES)
    assert {tuple(r) for r in graph.reach_sets(nodes, entries, none).collect()} == {("r", 3, "p#1"), ("s", 0, "p#2")}
    assert {tuple(r) for r in graph.least_entry(none, nodes, entries).collect()} == {("r", "p#1", 3), ("s", "p#2", 0)}
    assert graph.condensed(none)[0].isEmpty()


def test_depths(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "a", "c"), ("r", "c", "a"), ("s", "a", "z")], EDGES)
    seeds = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "repo string, entry int, node string")
    got = {tuple(r) for r in graph.reachable(edges, seeds, ["repo", "entry"]).collect()}
    assert got == {("r", 1, "a", 0), ("r", 1, "b", 1), ("r", 1, "c", 1), ("r", 2, "b", 0), ("r", 2, "c", 1), ("r", 2, "a", 2)}
    assert graph.reachable(edges, seeds, ["repo", "entry"], depth=1).count() == 5


def flow(spark, seams, entries, edges, nodes, **more):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "flows": made([("r", True, 1, ["update_in_place"], {"LOST-UPDATE": "not here"}, "tenant_id", "chain")], "repo string, tenant_scheme boolean, hash_chains int, patterns array<string>, skipped map<string,string>, tenancy string, first_chain string"),
        "entries": made(entries, ENTRIES),
        "nodes": made([("r", i, f, True, True, True) for i, f in nodes], "repo string, id string, file string, handles_money boolean, opens_tx boolean, spawns_goroutine boolean"),
        "edges": made([("r", *e) for e in edges], EDGES),
        "seams": made([("r", k, *s) for k, s in enumerate(seams)], "repo string, ord int, kind string, target string, in_id string, injectable boolean"),
        "machines": made([("r", 0, "Small", ["A"]), ("r", 1, "Plain", ["A", "B"]), ("r", 2, "Full", ["A", "B"])], "repo string, ord int, type string, states array<string>"),
        "roles": made([("r", "Full", [(True, False, False), (False, True, False)]), ("r", "Small", [(True, True, False)])], "repo string, type string, roles array<struct<initializing:boolean,final:boolean,foreign:boolean>>"),
        "facts": made([("r", "Money", "", "Move", "key", True)], "repo string, money_type string, balance_func string, transfer_func string, idempotency_key string, known boolean"),
    } | more


def test_complete_cases(spark):
    seams = [("http", "same", "p#deep", True), ("queue", "same", "p#near", False), ("http", "far", "p#unmet", True), ("db", "table", "p#other", False), ("clock", "now", "p#deep", True)]
    entries = [("r", 0, "p", "first"), ("r", 1, "p", "second")]
    edges = [("p#first", "p#near"), ("p#second", "p#deep"), ("p#near", "p#deep"), ("p#second", "p#other")]
    nodes = [("p#first", "cmd/a/main.go"), ("p#second", "root.go"), ("p#near", "x/y.go"), ("p#deep", "x/z.go"), ("p#other", "x/o.go"), ("p#unmet", "u.go")]
    got = payments.selected(flow(spark, seams, entries, edges, nodes))
    cases = {r.scenario: r for r in got["cases"].collect()}
    own: dict[str, list] = {}
    for r in got["seams"].collect():
        own.setdefault(r.scenario, []).append((r.target, r.in_id))
    at = {}
    for r in got["entries"].collect():
        at.setdefault(r.scenario, []).append(r.entry_ord)
    # Of two seams with one target, both reached by the first entry, the kind that is named first wins; far isn't reached.
    assert own["TIMEOUT-UNKNOWN-OUTCOME"] == [("same", "p#deep")] and sorted(at["TIMEOUT-UNKNOWN-OUTCOME"]) == [0, 1]
    assert own["AT-LEAST-ONCE-DELIVERY-IS-SAFE"] == [("same", "p#near")] and at["AT-LEAST-ONCE-DELIVERY-IS-SAFE"] == [0]
    assert sorted(own["IDEM-REPLAY"]) == [("now", "p#deep"), ("same", "p#deep")]
    assert "LOST-UPDATE" not in own and cases["LOST-UPDATE"].blocked == "skipped by rule: not here" and cases["LOST-UPDATE"].target_file is None
    row = cases["FINAL-STATE-IS-FINAL"]
    assert (row.machine, row.n_seams, row.n_entries, row.func_name, row.target_pkg, row.target_file) == ("Full", 0, 1, "TestFinalStateIsFinal", "p", "cmd/a/state_test.go")
    assert cases["TENANT-ROWS-DONT-LEAK"].tenancy == "tenant_id" and cases["TENANT-ROWS-DONT-LEAK"].target_file == "cmd/a/consistency_integration_test.go"
    assert cases["HASH-CHAIN-CATCHES-TAMPERING"].hash_chain == "chain" and cases["IDEM-REPLAY"].hash_chain is None
    assert cases["CONSERVATION-UNDER-CONCURRENCY"].blocked == "no balance function"
    places = sorted(cases.values(), key=lambda r: r.place)
    assert [r.runnable for r in places] == sorted((r.runnable for r in places), reverse=True)


def test_cases_of_a_flow_without_entries(spark):
    seams = [("http", "a", "p#x", True), ("http", "b", "p#nowhere", True)]
    got = payments.selected(flow(spark, seams, [], [], [("p#x", "x.go")]))
    row = {r.scenario: r for r in got["cases"].collect()}["TIMEOUT-UNKNOWN-OUTCOME"]
    # All nodes are in reach, but there is nothing to enter by.
    assert (row.n_seams, row.n_entries, row.target_pkg, row.target_file) == (1, 0, "", "./failure_test.go")
    assert got["entries"].isEmpty()


def test_demand_follows_requirements(spark):
    cases = spark.createDataFrame([("r", True, "A", "unit", ["transfer"]), ("r", True, "B", None, ["machine"]), ("r", False, "C", None, ["key"]), ("k", True, "A", "unit", ["key"]), ("n", True, "MONEY", "unit", ["tx"]), ("n", True, "X", "unit", None)], "repo string, runnable boolean, scenario string, technique string, requires array<string>")
    got = {r.repo: (r.money, r.main_entity, r.runnable, r.blocked) for r in rollups.demand(cases).collect()}
    assert got == {"r": (True, False, 2, 1), "k": (True, True, 1, 0), "n": (False, False, 2, 0)}
    machines = spark.createDataFrame([("r", "M", ["A", "B"]), ("r", "N", ["A"]), ("k", "M", ["A", "B"])], "repo string, type string, states array<string>")
    assert [(r.repo, r.machine, r.scenarios) for r in rollups.states_demanded(cases, machines).collect()] == [("r", "M", ["B"])]


def plain_preorder(calls, entries, nodes):
    """(entry_ord, step, depth, node) of a recursive walk; calls: (src, ord, dst)."""
    of, seen, out = {}, set(), []
    for s, o, d in calls:
        of.setdefault(s, []).append((o, d))

    def visit(entry, node, depth, steps):
        seen.add(node)
        out.append((entry, next(steps), depth, node))
        for _, d in sorted(of.get(node, [])):
            if d in nodes and d not in seen:
                visit(entry, d, depth + 1, steps)

    for entry, node in sorted(entries):
        if node in nodes and node not in seen:
            visit(entry, node, 0, itertools.count())
    return out


@pytest.mark.parametrize("most", [0, 6, 10**6])
def test_split_preorder_is_that_of_a_plain_walk(spark, most):
    """Trees with cross calls, cycles, ties, repeated calls, loops and absent callees, split at every size."""
    draw = random.Random(8)
    calls = {("r", f"p#{draw.randint(0, k)}", draw.randint(0, 3), f"p#{k + 1}") for k in range(24)} | {("r", f"p#{draw.randint(0, 30)}", draw.randint(0, 3), f"p#{draw.randint(0, 30)}") for _ in range(14)} | {("r", "p#2", 1, "gone"), ("r", "p#3", 1, "p#3")}
    calls |= {("t", "p#0", 0, "p#1"), ("t", "p#1", 0, "p#0"), ("t", "p#1", 5, "p#2")}
    entries = [("r", 3, "9"), ("r", 5, "0"), ("r", 5, "20"), ("r", 7, "26"), ("r", 8, "none"), ("t", 1, "1"), ("t", 2, "0")]
    nodes = {"r": {f"p#{k}" for k in range(31)}, "t": {f"p#{k}" for k in range(4)}}
    frames = spark.createDataFrame([(r, n) for r, ns in nodes.items() for n in ns], NODES), spark.createDataFrame([(r, o, "p", s) for r, o, s in entries], ENTRIES)
    edges = spark.createDataFrame([(r, s, d, o) for r, s, o, d in calls] * 2, "repo string, src string, dst string, ord int")
    got = sorted((r.repo, r.entry_ord, r.step, r.depth, r.node) for r in graph.preorder(*frames, edges, most).collect())
    want = [(r, *row) for r in nodes for row in plain_preorder({c[1:] for c in calls if c[0] == r}, [(o, f"p#{s}") for q, o, s in entries if q == r], nodes[r])]
    assert got == sorted(want) and len(got) > 25


def test_preorder_without_rows(spark, tangle):
    _, edges, nodes, entries, _ = tangle
    edges = edges.withColumn("ord", F.lit(0))
    assert graph.preorder(nodes, entries.where("false"), edges, 0).isEmpty() and graph.preorder(nodes.where("false"), entries, edges, 0).isEmpty()


def test_lines_are_written_in_order(spark, tmp_path):
    nodes = spark.createDataFrame([("r", f"p#{k:03}", f"f{k}") for k in range(300)] + [("s", "p#0", "g")], "repo string, id string, symbol string")
    edges = spark.createDataFrame([("r", "p#000", "p#001")], EDGES)
    seams = spark.createDataFrame([], "repo string, in_id string, target string, injectable boolean")
    lines = graph.flowchart_lines(nodes, edges, seams)
    assert [r.line for r in lines.where("repo = 'r'").orderBy("line").collect()] == list(range(302))
    files.write_lines(lines, str(tmp_path / "charts"))
    read = lambda repo: "".join(f.read_text() for f in sorted((tmp_path / "charts" / f"repo={repo}").glob("*.txt")))
    charts = {r.repo: r.diagram for r in graph.flowchart(nodes, edges, seams).collect()}
    assert {repo: read(repo).rstrip("\n") for repo in ("r", "s")} == charts and charts["r"].count("\n") == 301


def test_keys_travel_together_as_bits(spark, monkeypatch):
    """A node has a row for 64 entries that reach it at once, not one for each; marks of a part are unpacked before its nodes are met."""
    tables = []
    whole = graph.spread
    monkeypatch.setattr(graph, "spread", lambda *args, **more: tables.append(whole(*args, **more)) or tables[-1])
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([(k, "a") for k in range(100)] + [(7, "c")], "entry int, node string")
    got = {tuple(r) for r in graph.reachable(edges, seeds, ["entry"]).collect()}
    assert got == {(k, n, d) for k in range(100) for d, n in enumerate("abc")} - {(7, "c", 2)} | {(7, "c", 0)}
    assert tables[0].read().count() <= 7


def test_labels_of_parts_are_numbers(spark, tangle, monkeypatch):
    """Labels that no hash aggregate can hold are sorted in each round."""
    seen = []
    whole = graph.spread
    monkeypatch.setattr(graph, "spread", lambda laid, seeds, *args, **more: seen.append(dict(seeds.dtypes)["value"]) or whole(laid, seeds, *args, **more))
    _, edges, nodes, entries, _ = tangle
    graph.condensed(edges)
    graph.preorder(nodes, entries, edges.withColumn("ord", F.lit(0)), 6)
    assert seen and set(seen) == {"bigint"}


def test_equal_hashes_of_nodes_get_another_salt(spark, tangle, monkeypatch):
    whole = graph.node_id
    monkeypatch.setattr(graph, "node_id", lambda name, salt: whole(name, salt) if salt else F.pmod(whole(name, salt), F.lit(5)))
    test_reach_sets_are_those_of_plain_walks(tangle)
    test_parts_are_the_strongly_connected_ones(tangle)


def test_lines_are_numbered_without_another_shuffle(spark):
    rows = spark.range(500).select(F.lit("r").alias("repo"), (F.col("id") % 400).cast("string").alias("text"))
    laid = ranking.ordered(rows, ["repo"], ["text"], distinct=True)
    numbered = ranking.counted(laid, ["repo"], "line")
    assert [r.text for r in numbered.orderBy("line").collect()] == sorted(map(str, range(400)))
    assert sorted(r.line for r in numbered.collect()) == list(range(400))
    assert "Exchange hashpartitioning" not in numbered._jdf.queryExecution().executedPlan().toString()


def test_clusters_are_the_connected_nodes(spark):
    """Hubs, chains of growing degree, rings and pairs of equal degree, taken in over several rounds."""
    draw = random.Random(5)
    pairs = {(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(260)} | {(1000, 1001 + k) for k in range(40)} | {(2000 + k, 2001 + k) for k in range(70)} | {(2070, 2000)} | {(3000 + 20 * k, 3000 + 20 * k + j) for k in range(12) for j in range(1, k + 1)} | {(3000 + 20 * k, 3020 + 20 * k) for k in range(11)} | {(-5, 4000), (4001, 4002)}
    pairs = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    both = [(a, b) for p in pairs for a, b in (p, p[::-1])]
    got = [(r.node, r.part) for r in graph.clustered(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()]
    part = dict(got)
    assert len(part) == len(got) and set(part) == {n for p in pairs for n in p}
    groups: dict = {}
    for n, p in got:
        groups.setdefault(p, set()).add(n)
    assert all(p in group and group == walk(both, p) for p, group in groups.items())
    assert graph.clustered(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_calls_of_both_ways_need_no_labels(spark, monkeypatch):
    """What they tie together is one part without a walk; labels go over the rest only."""
    seen = []
    whole = graph.spread
    monkeypatch.setattr(graph, "spread", lambda laid, *args, **more: seen.append(laid.read().count()) or whole(laid, *args, **more))
    rows = [("r", f"s#{k}", f"p#{j}") for k in range(6) for j in range(30) if j % 6 in (k, k // 2)]
    tied = [*rows, *[(r, d, s) for r, s, d in rows]]
    members, between = graph.condensed(spark.createDataFrame(tied, EDGES))
    parts = {r.node: r.part for r in members.collect()}
    assert not seen and between.isEmpty() and len(parts) == 36
    assert all((parts[a] == parts[b]) == (b in walk([e[1:] for e in tied], a)) for a in parts for b in parts)
    ring = [("r", "p#0", "x#0"), ("r", "x#0", "x#1"), ("r", "x#1", "s#0"), ("r", "x#1", "x#9")]
    members, between = graph.condensed(spark.createDataFrame([*tied, *ring], EDGES))
    more = {r.node: r.part for r in members.collect()}
    assert seen and max(seen) <= 3
    assert {n for n in more if more[n] == more["x#0"]} == walk([e[1:] for e in tied], "p#0") | {"x#0", "x#1"}
    assert [tuple(r) for r in between.collect()] == [("r", more["x#0"], "x#9")]


def _walked_by(spark, monkeypatch, calls, entries, most):
    """What preorder gives for the calls (src, ord, dst), and over how many tables labels went."""
    seen = []
    whole = graph.spread
    monkeypatch.setattr(graph, "spread", lambda *args, **more: seen.append(1) or whole(*args, **more))
    nodes = sorted({n for s, _, d in calls for n in (s, d)})
    frames = spark.createDataFrame([("r", n) for n in nodes], NODES), spark.createDataFrame([("r", o, "p", s) for o, s in entries], ENTRIES), spark.createDataFrame([("r", s, d, o) for s, o, d in calls], "repo string, src string, dst string, ord int")
    got = sorted((r.entry_ord, r.step, r.depth, r.node) for r in graph.preorder(*frames, most).collect())
    assert got == sorted(plain_preorder(set(calls), [(o, f"p#{s}") for o, s in entries], set(nodes)))
    return len(seen)


def test_what_is_not_connected_is_walked_apart(spark, monkeypatch):
    """A repo of several small groups is not split by labels; a name's order among calls of equal ord is kept."""
    calls = [(f"p#{k}{a}", 0, f"p#{k}{b}") for k in range(4) for a, b in (("a", "c"), ("a", "b"), ("b", "d"), ("d", "a"))]
    assert _walked_by(spark, monkeypatch, calls, [(1, "0a"), (2, "1d"), (3, "2b"), (4, "0c")], 12) == 0


def test_a_knot_is_not_split_on_and_on(spark, monkeypatch):
    calls = [(f"p#{a:02}", (a * b) % 7, f"p#{b:02}") for a in range(30) for b in range(30) if a != b]
    assert _walked_by(spark, monkeypatch, calls, [(1, "05"), (2, "03")], 100) == 2


def test_a_text_is_put_together_from_runs(spark):
    """Lines in any order and number, nulls among them; no list of a repo's lines is gathered."""
    rows = [(f"r{k % 3}" if k % 4 else None, k, None if k % 11 == 0 else f"ü{k}\n" if k % 13 == 0 else f"t{k}") for k in range(200)]
    lines = spark.createDataFrame(random.Random(1).sample(rows[:100], 100) + rows[100:], "repo string, line long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = graph._joined(lines)
        got = [tuple(r) for r in texts.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 4 and dict(got) == {repo: "\n".join(t for r, _, t in rows if r == repo and t is not None) for repo in ("r0", "r1", "r2", None)}
    assert "collect_list" not in texts._jdf.queryExecution().executedPlan().toString()
    assert graph._joined(lines.where("false")).isEmpty()
    numbered = spark.createDataFrame([(7, 0, "a"), (8, 0, "b"), (7, 1, "c")], "repo int, line long, text string")
    assert sorted(tuple(r) for r in graph._joined(numbered).collect()) == [(7, "a\nc"), (8, "b")]


def test_tasks_need_no_package(tmp_path):
    """Functions of the walks and texts are loaded where this package is not."""
    for made in (graph._walker, graph._runner, graph._texter):
        subprocess.run([sys.executable, "-c", "import sys, pickle; assert callable(pickle.loads(sys.stdin.buffer.read()))"], input=cloudpickle.dumps(made()), cwd=tmp_path, check=True)
