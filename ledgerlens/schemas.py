"""The tables of the rule engine. Each has the repo that its rows belong to."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "flows": "repo string, module string, schema_version int, generated_at string, tenant_scheme boolean, hash_chains int, patterns array<string>",
    "entries": "repo string, ord int, pkg string, symbol string, label string",
    "nodes": "repo string, id string, pkg string, symbol string, file string, line int, opens_tx boolean, commits_tx boolean, rolls_back_tx boolean, touches_db boolean, touches_net boolean, reads_clock boolean, randomness boolean, spawns_goroutine boolean, handles_money boolean, writes_status array<string>",
    "edges": "repo string, src string, dst string, ord int",
    "seams": "repo string, ord int, in_id string, kind string, target string, line int, injectable boolean, iface string",
    "machines": "repo string, ord int, type string, field string, states array<string>, never_assigned array<string>",
    "state_writes": "repo string, type string, to string, in_id string, line int, in_tx boolean",
    "findings": "repo string, ord int, id string, severity string, title string, place string",
    "candidates": "repo string, ord int, role string, name string, owner string, type string, declarative boolean, decided boolean, weight int",
    "db_columns": "repo string, table string, column string, type string, not_null boolean, default string, primary_key boolean",
    "db_constraints": "repo string, kind string, table string, columns array<string>",
    "answers": "repo string, question string, verdict boolean, info string",
    "effects": "repo string, target string, changes_external_state string, reversible_by_rollback string, outcome_observable string, accepts_dedup_key string, moves_money string",
    "asks": "repo string, ord int, kind string, subject string, prompt string, asks int, output int, settled boolean",
    "runs": "repo string, case_id string, ord int, status string, passed boolean",
    "skip_rules": "repo string, scenario string, why string",
}

CONFIG = "module string, entries array<struct<pkg:string,symbol:string,label:string>>"
RULES = "skip array<struct<scenario:string,why:string>>, money_symbols array<string>"
STATE = "schema_version int, money_model string, binding string, main_entity string, state_roles map<string,string>, external_effects map<string,string>, questions map<string,struct<verdict:boolean,info:string>>, payment_kind string, test_runs array<struct<case_id:string,status:string,passed:boolean>>"
MANIFEST = "round int, batches array<struct<id:string,kind:string,items:array<struct<kind:string,title:string,subject:string,questions:array<string>>>>>"
