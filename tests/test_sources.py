"""Sources and sinks on small files."""

from __future__ import annotations

import json

import pytest

from ledgerlens.sources import files


def put(root, repo, name, text):
    folder = root / repo
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_config_drops_comment_lines_only(spark, tmp_path):
    put(tmp_path, "a", "config.json", '{\n  // a comment\n  "module": "m", "entries": [{"pkg": "p", "symbol": "S", "label": "x // y"}]\n}')
    row = files.read_config(spark, f"{tmp_path}/*/config.json").first()
    assert (row.repo, row.pkg, row.symbol, row.label, row.ord) == ("a", "p", "S", "x // y", 0)
    put(tmp_path, "b", "config.json", '{"module": "m", "entries": [{"pkg": "p"}]}')
    with pytest.raises(Exception, match="an entry needs"):
        files.read_config(spark, f"{tmp_path}/*/config.json").collect()


def test_rules_are_optional(spark, tmp_path):
    put(tmp_path, "a", "rules.json", '{"skip": [{"scenario": "X", "why": "w"}], "money_symbols": ["T"]}')
    repos = spark.createDataFrame([("a",), ("b",)], "repo string")
    got = {r.repo: r.skipped for r in files.read_rules(spark, f"{tmp_path}/*/rules.json", repos).collect()}
    assert got == {"a": {"X": "w"}, "b": None}


def test_flow_version_and_missing_arrays(spark, tmp_path):
    put(tmp_path, "a", "flow.json", '{"schema_version": 1}')
    schema = "schema_version int, nodes array<struct<id:string>>"
    assert files.read_flow(spark, f"{tmp_path}/*/flow.json", schema).first().nodes == []
    put(tmp_path, "b", "flow.json", '{"schema_version": 9}')
    with pytest.raises(Exception, match="unknown flow version"):
        files.read_flow(spark, f"{tmp_path}/*/flow.json", schema).collect()


def test_state_is_fresh_where_missing_and_renames(spark, tmp_path):
    put(tmp_path, "a", "state.json", '{"schema_version": 2, "binding": "old", "state_roles": {"M": "r"}}')
    put(tmp_path, "c", "state.json", '{"schema_version": 2, "binding": "old", "money_model": "new"}')
    repos = spark.createDataFrame([("a",), ("b",), ("c",)], "repo string")
    got = {r.repo: r for r in files.read_state(spark, f"{tmp_path}/*/state.json", repos).collect()}
    assert got["a"].money_model == "old" and got["c"].money_model == "new"
    assert got["b"].state_roles == {} and got["b"].money_model is None and got["b"].questions == {}


def test_pack_answers_and_sizes(spark, tmp_path):
    row = lambda repo, k, prompt: (repo, 1, k, f"k{k}", f"b{k}", "t", "s", ["q"], prompt)
    pack = lambda *rows: files.write_pack(spark.createDataFrame(list(rows), files.PACK), f"{tmp_path}/pack")
    pack(row("a", 0, "p"), row("a", 1, "qq"))
    pack(row("b", 0, "p"))
    pack(row("a", 2, "päp"))
    kept = files.read_pack(spark, f"{tmp_path}/pack")
    assert sorted((r.repo, r.batch, r.prompt) for r in kept.collect()) == [("a", "b2", "päp"), ("b", "b0", "p")]
    answers = spark.createDataFrame([("a", "b2", "{}")], "repo string, batch string, raw string")
    assert {r.repo: (r.n_asks, r.asks_bytes, r.answers_bytes, r.missing) for r in files.pack_sizes(kept, answers).collect()} == {"a": (1, 4, 2, 0), "b": (1, 1, 0, 1)}
    one = spark.createDataFrame([("a", "b1", 1, "x")], "repo string, batch string, ord int, raw string")
    files.append_answer(one, f"{tmp_path}/answers.parquet")
    files.append_answer(one.selectExpr("repo", "batch", "2 as ord", "'y' as raw"), f"{tmp_path}/answers.parquet")
    assert [r.raw for r in files.read_answers(spark, f"{tmp_path}/answers.parquet").collect()] == ["y"]
    put(tmp_path / "run" / "a", "asks", "1.md", "12345")
    put(tmp_path / "run" / "a", "asks", "2.md", "1")
    put(tmp_path / "run" / "a", "answers", "1.json", "{}")
    row = files.sizes(spark, f"{tmp_path}/run/*/asks", f"{tmp_path}/run/*/answers").first()
    assert (row.repo, row.n_asks, row.asks_bytes, row.answers_bytes, row.missing) == ("a", 2, 6, 2, 1)


def test_manifest_keeps_order(spark, tmp_path):
    pack = {"round": 1, "batches": [{"id": "b", "kind": "k", "items": [{"kind": "k", "title": "t1", "subject": "s", "questions": ["q"]}, {"kind": "k", "title": "t2", "subject": "", "questions": []}]}]}
    put(tmp_path, "a", "manifest.json", json.dumps(pack))
    rows = files.read_manifest(spark, f"{tmp_path}/*/manifest.json").orderBy("ord").collect()
    assert [(r.batch, r.ord, r.title, r.questions) for r in rows] == [("b", 0, "t1", ["q"]), ("b", 1, "t2", [])]


def test_repos_are_saved_one_by_one_and_read_back(spark, tmp_path):
    save = lambda repo, model: files.write_json(spark.createDataFrame([(repo, 2, model, {"M": "r"})], "repo string, schema_version int, money_model string, state_roles map<string,string>"), f"{tmp_path}/state")
    for repo, model in (("a", "one"), ("b c:1", "two"), ("007", "three"), ("a", "four")):
        save(repo, model)
    repos = spark.createDataFrame([("a",), ("b c:1",), ("007",)], "repo string")
    got = {r.repo: (r.money_model, r.state_roles) for r in files.read_state(spark, f"{tmp_path}/state/*/*.json", repos).collect()}
    assert got == {"a": ("four", {"M": "r"}), "b c:1": ("two", {"M": "r"}), "007": ("three", {"M": "r"})}
    files.write_json(spark.createDataFrame([("a", 1, [("n",)]), ("b", 1, [])], "repo string, schema_version int, nodes array<struct<id:string>>"), f"{tmp_path}/flow")
    flows = files.read_flow(spark, f"{tmp_path}/flow/*/*.json", "schema_version int, nodes array<struct<id:string>>, edges array<string>").collect()
    assert {r.repo: ([n.id for n in r.nodes], r.edges) for r in flows} == {"a": (["n"], []), "b": ([], [])}


def test_manifests_are_read_back(spark, tmp_path):
    rows = [("a", 1, 1, "k", "b", "t2", "s", ["q"], "p"), ("a", 1, 0, "k", "b", "t1", "s", [], "p"), ("a", 1, 2, "m", "c", "t3", "", ["x"], "p")]
    files.write_json(files.manifests(spark.createDataFrame(rows, files.PACK)), f"{tmp_path}/manifest")
    got = files.read_manifest(spark, f"{tmp_path}/manifest/*/*.json").orderBy("batch_ord", "ord").collect()
    assert [(r.repo, r.batch, r.ord, r.title, r.questions) for r in got] == [("a", "b", 0, "t1", []), ("a", "b", 1, "t2", ["q"]), ("a", "c", 0, "t3", ["x"])]


def test_documents(spark, tmp_path):
    root = tmp_path / "docs"
    put(root, "a", "one.md", "# Refund flow\nrefund refund refund refund refund ledger")
    put(root, "a", "TWO.ADOC", "the ledger")
    put(root, "a", "none.md", "nothing here")
    put(root, "a", "skip.txt", "refund")
    put(root / "a", "vendor", "x.md", "refund")
    rows = files.scored_documents(files.read_documents(spark, str(root))).orderBy("rank").collect()
    assert [(r.path, r.score, r.topics, r.title) for r in rows] == [("a/one.md", 12, ["ledger", "reversal"], "Refund flow"), ("a/TWO.ADOC", 1, ["ledger"], "")]
