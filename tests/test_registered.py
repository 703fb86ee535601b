"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from ledgerlens.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((repr([plain(r[c]) for c in columns]) for r in df.collect()))
    result = duck.sql(catalogue.oracle_sql()[name])
    at = [result.columns.index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())
    assert ours == theirs


def test_every_query_but_the_walk_has_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"call_preorder"}


def test_the_walk_is_depth_first(spark, duck):
    calls: dict = {}
    for n, s, p, first in duck.sql("select s_nationkey, l_suppkey, l_partkey, min(l_orderkey) from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2, 3").fetchall():
        calls.setdefault((n, f"s#{s}"), []).append((first, f"p#{p}"))
        calls.setdefault((n, f"p#{p}"), []).append((s, f"s#{s}"))
    want, seen = [], set()

    def walk(nation, entry, start):
        stack, step = [(start, 0)], 0
        while stack:
            node, depth = stack.pop()
            if (nation, node) in seen or (nation, node) not in calls:
                continue
            seen.add((nation, node))
            want.append((f"n{nation}", entry, step, depth, node))
            step += 1
            stack += [(x, depth + 1) for _, x in sorted(calls[nation, node], reverse=True)]

    for n, s in sorted(duck.sql("select s_nationkey, s_suppkey from supplier where s_nationkey % 5 <> 0").fetchall()):
        walk(n, s, f"s#{s}")
    got = [tuple(r) for r in catalogue.queries()["call_preorder"](spark, SF).select("repo", "entry_ord", "step", "depth", "node").collect()]
    assert sorted(got) == sorted(want)


def test_the_plan_has_every_case(duck):
    rows = duck.sql(f"select chosen, over, kind, why, weighted from ({catalogue.oracle_sql()['ask_plan']})").fetchall()
    assert any(over and not chosen for chosen, over, *_ in rows) and any(why == "seam not in demand" for *_, why, _ in rows)
    assert all(w < 1000 for _, _, kind, _, w in rows if kind == "other") and any(avoided > 0 for (avoided,) in duck.sql(f"select avoided from ({catalogue.oracle_sql()['plan_report']})").fetchall())
