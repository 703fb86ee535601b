"""Budgets, trims, word counts and snapshots on groups that no single task should hold."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import predicates, ranking, state
from ledgerlens.operators.words import word_counts
from ledgerlens.plans import payments
from ledgerlens.sources import files
from ledgerlens.sources.snapshots import Snapshots


@pytest.mark.parametrize("rounds", [1, 2, 8])
def test_split_first_fit_is_first_fit(spark, rounds):
    draw = random.Random(rounds)
    rows = [("big", k, draw.choice([0, 1, 5, 40, 300, None]), 2000) for k in range(3000)] + [("none", k, 7, 0) for k in range(20)] + [(None, k, 4, 9) for k in range(5)]
    # Nearly every second row is just too heavy: more rounds than there are.
    rows += [("hard", k, 1 if k % 2 == 0 else 200 - k // 2, 200) for k in range(200)]
    df = spark.createDataFrame(rows, "repo string, ord int, w int, budget int")
    plain = {(r.repo, r.ord): (r.place, r.taken, r.spent) for r in ranking.first_fit(df, ["repo"], ["ord"], "w", F.col("budget")).collect()}
    split = {(r.repo, r.ord): (r.place, r.taken, r.spent) for r in ranking.first_fit_split(df, ["repo"], ["ord"], "w", F.col("budget"), rounds).collect()}
    assert split == plain and len(split) == len(rows)


def test_one_repo_is_spread_over_tasks(spark):
    df = spark.range(4000).select(F.lit("r").alias("repo"), F.col("id").alias("ord"), F.lit(3).alias("w"))
    laid = ranking.ordered(df, ["repo"], ["ord"])
    parts = laid.groupBy(F.shiftrightunsigned("_id", 33).alias("part")).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2000
    sums = ranking.before(laid, ["repo"], {"s": F.col("w")}).orderBy("ord").collect()
    assert [r.s for r in sums] == [3 * k for k in range(4000)]


def test_split_trim_is_trim(spark):
    draw = random.Random(2)
    df = spark.createDataFrame([(draw.choice("ab"), k, draw.randint(1, 90), draw.random() < 0.7) for k in range(1000)], "repo string, ord int, size int, loose boolean")
    one, two = (ranking.trimmed(df, ["repo"], [F.desc("size"), F.col("ord")], "size", F.lit(9000), F.col("loose"), split=s) for s in (False, True))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert {r.dropped for r in one.collect()} == {True, False}


@pytest.mark.parametrize("a_pass", [2, 100_000])
def test_words_are_counted_without_overlaps(spark, a_pass):
    texts = spark.createDataFrame([(1, "aaaaa refund refunds re"), (2, ""), (3, None), (4, "ünüñü ab abab"), (5, "nothing")], "id int, low string")
    words = ["aa", "aaa", "refund", "re", "ab", "abab", "ü", "zzz", "", "aa"]
    got = {(r.id, r.word): r.n for r in word_counts(texts, ["id"], "low", spark.createDataFrame([(w,) for w in words], "word string"), a_pass).collect()}
    assert got == {(r.id, w): (r.low or "").count(w) for r in texts.collect() for w in set(words) if w and (r.low or "").count(w)}


def test_documents_are_scored_in_one_pass(spark):
    docs = spark.createDataFrame([("r", "a.md", "refund " * 5)], "repo string, path string, text string")
    scored = files.scored_documents(docs)
    assert [r.score for r in scored.collect()] == [10]
    assert "NestedLoop" not in scored._jdf.queryExecution().executedPlan().toString()


def flows(spark, rows):
    return spark.createDataFrame(rows, "repo string, schema_version int, money_model string, state_roles map<string,string>")


def test_a_save_that_fails_changes_nothing(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "state"))
    repos = spark.createDataFrame([("a",), ("b c:1",), ("007",)], "repo string")
    read = lambda: {r.repo: r.money_model for r in files.read_state(spark, table, repos).collect()}
    assert read() == {"a": None, "b c:1": None, "007": None}
    table.save(flows(spark, [("a", 2, "one", {"M": "r"}), ("b c:1", 2, "two", {})]))
    table.save(flows(spark, [("007", 2, "three", {}), ("a", 2, "four", {"M": "s"})]))
    assert read() == {"a": "four", "b c:1": "two", "007": "three"}
    broken = flows(spark, [(f"r{k}", 2, "x", {}) for k in range(50)] + [("a", 2, "lost", {})]).withColumn("money_model", F.when(F.assert_true(F.col("repo") != "r49", F.lit("half way")).isNull(), F.col("money_model")))
    with pytest.raises(Exception, match="half way"):
        table.save(broken)
    assert read() == {"a": "four", "b c:1": "two", "007": "three"}
    # Files without an entry in the log are not read.
    flows(spark, [("a", 2, "stray", {})]).write.partitionBy("repo").json(str(tmp_path / "state" / "stray"))
    assert read()["a"] == "four"
    table.compact()
    assert read() == {"a": "four", "b c:1": "two", "007": "three"} and len({f.split("/")[-2] for f in table.folders()}) == 1
    table.save(flows(spark, [("a", 2, "five", {})]))
    assert read() == {"a": "five", "b c:1": "two", "007": "three"}
    with pytest.raises(RuntimeError, match="saved meanwhile"):
        table._enter("x", base=True, upto=0)


def test_answer_logs_are_folded(spark, tmp_path):
    schema = "repo string, batch string, ord int, raw string"
    log = str(tmp_path / "answers.parquet")
    for k, raw in enumerate(("one", "two", None)):
        files.append_answer(spark.createDataFrame([("a", "b1", k, raw), ("b", f"b{k}", 0, "x")], schema), log)
    held = sorted(map(tuple, files.read_answers(spark, log).collect()), key=repr)
    assert held == [("a", "b1", 2, None), ("b", "b0", 0, "x"), ("b", "b1", 0, "x"), ("b", "b2", 0, "x")]
    kept = Snapshots(spark, str(tmp_path / "kept"))
    assert files.folded_answers(spark, kept, schema).count() == 0
    files.fold_answers(spark, log, kept)
    assert sorted(map(tuple, files.folded_answers(spark, kept, schema).select("repo", "batch", "ord", "raw").collect()), key=repr) == held


def test_kinds_of_rows_are_kinds_of_gathered_facts(spark):
    from ledgerlens.operators import rollups
    from ledgerlens.plans.flow_queries import VOCABULARY

    draw = random.Random(6)
    name = {"table": ("table", "tables"), "column": ("column", "columns"), "field": ("field", "column"), "symbol": ("symbol", "symbol"), "state": ("state", "state"), "value": ("value", None)}
    pick = {k: VOCABULARY.get({"field": "column"}.get(k, k), ["USD", "EUR", "xx"]) for k in name}
    rows = {k: [(f"r{draw.randint(0, 30)}", draw.choice(v).title() if k in ("table", "symbol") else draw.choice(v)) for _ in range(25)] for k, v in pick.items()}
    frames = [spark.createDataFrame(rows[k], f"repo string, {k} string") for k in ("table", "column", "field", "symbol", "state", "value")]
    every = spark.createDataFrame([(f"r{k}",) for k in range(31)], "repo string")
    machines = every.where("repo < 'r2'")
    gathered = every.join(rollups.gathered(*frames), "repo", "left").na.fill({"symbols": "", "currencies": 0})
    for c in ("tables", "columns", "fields", "states"):
        gathered = gathered.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    by_arrays = sorted(map(repr, payments.classified(gathered, machines).collect()))
    by_rows = sorted(map(repr, payments.classified_rows(payments.facts_as_rows(*frames), machines, every).collect()))
    assert by_rows == by_arrays and len({tuple(x.split("spine=")[1:]) for x in by_rows}) > 3


def test_facts_of_models_and_rules(spark):
    models = spark.createDataFrame([("a", "M", None, "T", "", "u"), ("b", None, None, None, None, None)], "repo string, money_type string, balance_func string, transfer_func string, idempotency_key string, uniqueness string")
    rules = spark.createDataFrame([("a", ["Move", "Other"], [("X", ""), ("Y", "w"), ("X", "last")]), ("c", [], None), ("d", ["Pay"], [("Z", None)])], "repo string, money_symbols array<string>, skip array<struct<scenario:string,why:string>>")
    got = {r.repo: (r.known, r.money_type, r.transfer_func, r.uniqueness, r.skipped) for r in predicates.facts_from(models, rules).collect()}
    assert got == {"a": (True, "M", "Move", "u", {"X": "last", "Y": "w"}), "b": (True, "", "", "", {}), "c": (False, "", "", "", {}), "d": (True, "", "Pay", "", {"Z": "no reason given"})}


def test_a_refused_round_is_reported_and_stopped(spark):
    cases = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "repo string, case_id int")
    closed = spark.createDataFrame([("a", ["x"], 0)], "repo string, missing array<string>, more long")
    assert Counter((r.repo, r.n_cases, r.refused) for r in state.gate_report(cases, closed).collect()) == Counter([("a", 2, True), ("b", 1, False)])
    with pytest.raises(Exception, match="round one is open for a"):
        state.gated(cases, closed).collect()


def test_asks_of_one_repo_are_planned_in_several_tasks(spark):
    k = F.col("id")
    choices = spark.range(400).select(F.lit("r").alias("repo"), k.alias("ord"), (k % 3 > 0).alias("chosen"), (k % 7).cast("double").alias("rank"), (10 + k % 5).alias("weighted"), F.lit("w").alias("why"), F.lit("open").alias("method"))
    plan = payments.planned(choices, spark.createDataFrame([("r", 100)], "repo string, budget long"))
    assert "MapInArrow" not in plan._jdf.queryExecution().toString()
    spent = 0
    for r in sorted(plan.collect(), key=lambda r: r.place):
        asked = r.ord % 3 > 0
        assert r.chosen == (asked and spent + r.weighted <= 100)
        spent += r.weighted if r.chosen else 0
