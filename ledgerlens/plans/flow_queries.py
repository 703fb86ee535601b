"""The payment plans over flow tables that Spark derives from the given ones: cases, kinds, asks, budgets and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import graph, ranking, rollups
from ledgerlens.plans import dims, payments
from ledgerlens.plans.registry import query, read
from ledgerlens.sources.shared import checkpointed


def flow_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Flow tables by analogy, a repo for each nation: suppliers are entries, customers nodes, their orders boundaries.

    Some nations have no boundaries of a kind and none that can be replaced, so that every reason occurs.
    """
    repo = F.concat(F.lit("n"), "n_nationkey")
    nation = read(spark, sf, "nation")
    customers = read(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("repo"), "c_nationkey", "c_custkey", "c_acctbal", "c_mktsegment")
    suppliers = read(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("repo"), "s_suppkey", "s_acctbal")
    n = F.col("c_nationkey")
    plain = F.element_at(F.array(*[F.lit(k) for k in ("http", "db", "queue", "clock", "random")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    kind = F.when((plain == "http") & (n % 4 == 1), "clock").when((plain == "queue") & (n % 4 < 2), "random").when((plain == "db") & (n % 7 == 3), "clock").otherwise(plain)
    orders = read(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    pattern = F.element_at(F.array(*[F.lit(k) for k in ("insert_only", "update_in_place", "upsert")]), F.col("n_nationkey") % 3 + 1)
    skipped = F.when(F.col("n_nationkey") % 4 == 0, F.create_map(F.lit("LOST-UPDATE"), F.lit("by rule")))
    return {
        "flows": nation.select(repo.alias("repo"), (F.col("n_regionkey") == 1).alias("tenant_scheme"), (F.col("n_nationkey") % 2).alias("hash_chains"), F.array(pattern).alias("patterns"), skipped.alias("skipped")),
        "entries": suppliers.where("s_acctbal > 4000").select("repo", "s_suppkey"),
        "nodes": customers.select("repo", (F.col("c_acctbal") > 9900).alias("handles_money"), (F.col("c_acctbal") < -950).alias("opens_tx"), ((F.col("c_acctbal") > 0) & (F.col("c_acctbal") < 100)).alias("spawns_goroutine")),
        "seams": orders.select("repo", kind.alias("kind"), ((F.col("o_orderpriority") == "1-URGENT") & (n % 5 != 3)).alias("injectable")),
        "machines": customers.where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select("repo"),
        "facts": nation.select(repo.alias("repo"), F.when(F.col("n_nationkey") % 2 == 0, "Money").alias("money_type"), F.when(F.col("n_nationkey") % 3 == 0, "Balance").alias("balance_func"), F.lit(None).cast("string").alias("transfer_func"), F.when(F.col("n_nationkey") % 5 != 0, "key").alias("idempotency_key"), (F.col("n_regionkey") > 1).alias("known")),
    }


def flow_cases(spark: SparkSession, sf: str) -> DataFrame:
    t = flow_tables(spark, sf)
    return ranking.case_order(payments.cases(payments.profile(t["flows"], t["entries"], t["nodes"], t["seams"], t["machines"], t["facts"])))


def _quoted(items) -> str:
    return "([" + ", ".join(f"'{x}'" for x in items) + "]::varchar[])"


def _cases_sql() -> str:
    lines = []
    for k, (i, family, severity, _, techniques, needs) in enumerate(dims.rows(dims.SCENARIOS)):
        plain = [x for x in needs.split() if ":" not in x]
        lines.append(f"({k}, '{i}', '{family}', '{severity}', {_quoted(techniques.split())}, {_quoted(plain)}, {_quoted(sorted(x[5:] for x in needs.split() if x.startswith('seam:')))}, {_quoted(x[6:] for x in needs.split() if x.startswith('write:'))})")
    need = lambda x: f"list_contains(needs, '{x}')"
    return f"""
        with sc(ord, scenario, family, severity, techniques, needs, seams, writes) as (values {", ".join(lines)}),
        c as (select c_nationkey as n, bool_or(c_acctbal > 9900) as money, bool_or(c_acctbal < -950) as tx, bool_or(c_acctbal > 0 and c_acctbal < 100) as go, bool_or(c_mktsegment = 'BUILDING' and c_acctbal > 9000) as machine from customer group by 1),
        s as (select s_nationkey as n, count(*) filter (where s_acctbal > 4000) as entries from supplier group by 1),
        ok as (select c_nationkey as n, ['http', 'db', 'queue', 'clock', 'random'][o_orderkey % 5 + 1] as kind, o_orderpriority = '1-URGENT' and c_nationkey % 5 <> 3 as inj from orders join customer on o_custkey = c_custkey),
        o as (select n, list_distinct(list(case when kind = 'http' and n % 4 = 1 then 'clock' when kind = 'queue' and n % 4 < 2 then 'random' when kind = 'db' and n % 7 = 3 then 'clock' else kind end)) as kinds, bool_or(inj) as inj from ok group by 1),
        p as (select n_nationkey as n, n_regionkey = 1 as tenant, n_nationkey % 2 as chains, ['insert_only', 'update_in_place', 'upsert'][n_nationkey % 3 + 1] as pattern, n_nationkey % 4 = 0 as skip, n_regionkey > 1 as known, n_nationkey % 2 = 0 as mt, n_nationkey % 3 = 0 as bf, n_nationkey % 5 <> 0 as key,
            coalesce(money, false) as money, coalesce(tx, false) as tx, coalesce(go, false) as go, coalesce(machine, false) as machine, coalesce(entries, 0) as entries, coalesce(kinds, []::varchar[]) as kinds, coalesce(inj, false) as inj
            from nation left join c on c.n = n_nationkey left join s on s.n = n_nationkey left join o on o.n = n_nationkey),
        b as (select p.*, sc.*, case when skip and scenario = 'LOST-UPDATE' then 'skipped by rule: by rule' when known and {need('balance')} and not bf then 'no balance function' when known and {need('transfer')} then 'no transfer function'
            when known and {need('key')} and not key then 'no idempotency key' when known and {need('money')} and not mt then 'no money type and no transfer function' when {need('machine')} and not machine then 'no state machine'
            when {need('entries')} and entries < 2 then 'fewer than two entries' when {need('money')} and not known and not money then 'no money in reach' when {need('tx')} and not tx then 'no transaction' when {need('goroutine')} and not go then 'no goroutine'
            when len(seams) > 0 and not list_has_any(seams, kinds) then 'no boundary of kind ' || array_to_string(seams, ' or ') when len(writes) > 0 and not list_contains(writes, pattern) then 'no table written by ' || array_to_string(writes, ' or ')
            when {need('injectable')} and not inj then 'no replaceable boundary' when {need('tenant')} and not tenant then 'no tenant column' when {need('hash_chain')} and chains = 0 then 'no hash chain' end as why from p cross join sc),
        t as (select *, list_filter(techniques, lambda x: inj or x <> 'faultInjection') as left_over from b),
        r as (select 'n' || n as repo, n, ord, scenario, family, severity, seams, needs, case when why is null then left_over[1] end as technique, case when why is null and len(left_over) = 0 then 'no technique is possible' else why end as blocked,
            case when why is null and len(left_over) > 0 then case when {need('database')} or left_over[1] = 'narrowIntegration' then 'medium' else 'small' end end as size from t),
        placed as (select *, row_number() over (partition by repo order by blocked is not null, case when severity = 'critical' then 0 else 1 end, ord) as place from r)"""


@query(f"{_cases_sql()} select repo, scenario, technique, size, blocked, place from placed")
def payment_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The whole catalogue over each nation's flow tables: why a scenario is blocked or how it is tested, in order."""
    return flow_cases(spark, sf).select("repo", "scenario", "technique", "size", "blocked", F.col("place").cast("long").alias("place"))


@query(f"{_cases_sql()} select repo, 'testCase' as kind, scenario as subject, technique, size, row_number() over (partition by repo order by place) as ord from placed where blocked is null")
def round_two(spark: SparkSession, sf: str) -> DataFrame:
    """The asks of the second round of each nation: its runnable cases."""
    return payments.in_round_two(flow_cases(spark, sf)).withColumn("ord", F.col("ord").cast("long"))


def walked_flow(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The flow tables with a call graph, places and states: suppliers call the customers of their lines, customers those that their orders name.

    Every third supplier has no node of its own, so it calls nothing; a third of the calls among customers go both ways.
    """
    t = flow_tables(spark, sf)
    customers = read(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("repo"), "c_custkey", "c_acctbal", "c_mktsegment")
    suppliers = read(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("repo"), "s_suppkey", "s_acctbal")
    at, by = F.concat(F.lit("c#"), "c_custkey"), F.concat(F.lit("s#"), "s_suppkey")
    orders = read(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    sold = read(spark, sf, "lineitem").join(orders.select("repo", "o_orderkey", "c_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("repo", F.col("l_suppkey").alias("s_suppkey"), "c_custkey")
    calls = sold.join(suppliers.where("s_suppkey % 3 <> 0").select("repo", "s_suppkey"), ["repo", "s_suppkey"]).select("repo", by.alias("src"), at.alias("dst"))
    named = orders.select("repo", at.alias("src"), (F.col("o_orderkey") % 1500 + 1).alias("other"), "o_orderkey").join(customers.select("repo", F.col("c_custkey").alias("other"), at.alias("dst")), ["repo", "other"])
    among = named.select("repo", "src", "dst").unionByName(named.where("o_orderkey % 3 = 0").select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")))
    known = customers.where("c_mktsegment = 'BUILDING' and c_acctbal > 9000")
    states = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("O"))).otherwise(F.array(F.lit("O"), F.lit("F"), F.lit("P")))
    role = F.struct((F.col("c_custkey") % 2 == 0).alias("initializing"), (F.col("c_custkey") % 5 == 0).alias("final"), F.lit(False).alias("foreign"))
    seam = read(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    plain = F.element_at(F.array(*[F.lit(k) for k in SEAM_KINDS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    n = F.substring("repo", 2, 9).cast("int")
    kind = F.when((plain == "http") & (n % 4 == 1), "clock").when((plain == "queue") & (n % 4 < 2), "random").when((plain == "db") & (n % 7 == 3), "clock").otherwise(plain)
    traits = [(F.col("c_acctbal") > 9900).alias("handles_money"), (F.col("c_acctbal") < -950).alias("opens_tx"), ((F.col("c_acctbal") > 0) & (F.col("c_acctbal") < 100)).alias("spawns_goroutine")]
    own = customers.select("repo", at.alias("id"), F.concat(F.lit("svc"), F.col("c_custkey") % 5, F.lit("/h.go")).alias("file"), *traits)
    mains = suppliers.where("s_suppkey % 3 <> 0").select("repo", by.alias("id"), F.concat(F.lit("cmd/x"), F.col("s_suppkey") % 4, F.lit("/main.go")).alias("file"), *[F.lit(False).alias(c) for c in ("handles_money", "opens_tx", "spawns_goroutine")])
    return t | {
        "flows": t["flows"].withColumn("tenancy", F.concat("repo", F.lit("_id"))).withColumn("first_chain", F.concat("repo", F.lit("_chain"))),
        "entries": suppliers.where("s_acctbal > 4000").select("repo", F.col("s_suppkey").cast("int").alias("ord"), F.lit("s").alias("pkg"), F.col("s_suppkey").cast("string").alias("symbol")),
        "nodes": own.unionByName(mains),
        "edges": calls.unionByName(among).distinct(),
        "seams": seam.select("repo", F.col("o_orderkey").alias("ord"), kind.alias("kind"), F.concat(F.lit("t"), F.col("o_orderkey") % 97).alias("target"), at.alias("in_id"), ((F.col("o_orderpriority") == "1-URGENT") & (n % 5 != 3)).alias("injectable")),
        "machines": known.select("repo", F.col("c_custkey").alias("ord"), at.alias("type"), states.alias("states")),
        "roles": known.where("c_custkey % 7 <> 0").select("repo", at.alias("type"), F.array(role).alias("roles")),
    }


SEAM_KINDS = ["http", "db", "queue", "clock", "random"]
#: The walk of walked_flow, the seams of each runnable case, and its entries.
WALK_SQL = f"""{_cases_sql().replace("with sc(", "with recursive sc(", 1)},
    ent as (select 'n' || s_nationkey as repo, cast(s_suppkey as int) as eo, 's#' || s_suppkey as node from supplier where s_acctbal > 4000),
    nod as (select 'n' || c_nationkey as repo, 'c#' || c_custkey as id, 'svc' || (c_custkey % 5) as dir from customer union all select 'n' || s_nationkey, 's#' || s_suppkey, 'cmd/x' || (s_suppkey % 4) from supplier where s_suppkey % 3 <> 0),
    oc as (select 'n' || c_nationkey as repo, c_nationkey as n, c_custkey, o_orderkey, o_orderpriority from orders join customer on o_custkey = c_custkey),
    amo as (select oc.repo, 'c#' || oc.c_custkey as a, 'c#' || c.c_custkey as b, o_orderkey from oc join customer c on c.c_custkey = o_orderkey % 1500 + 1 and 'n' || c.c_nationkey = oc.repo),
    edg as (select distinct repo, 's#' || l_suppkey as src, 'c#' || c_custkey as dst from lineitem join oc on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and 'n' || s_nationkey = repo where s_suppkey % 3 <> 0
        union select repo, a, b from amo union select repo, b, a from amo where o_orderkey % 3 = 0),
    rea as (select repo, eo, node from ent union select rea.repo, rea.eo, dst from rea join edg on edg.repo = rea.repo and src = node),
    met as (select * from rea union all select repo, 0, id from nod where repo not in (select repo from ent)),
    sea as (select repo, o_orderkey as so, 't' || (o_orderkey % 97) as target, 'c#' || c_custkey as in_id, o_orderpriority = '1-URGENT' and n % 5 <> 3 as inj,
        case when k = 'http' and n % 4 = 1 then 'clock' when k = 'queue' and n % 4 < 2 then 'random' when k = 'db' and n % 7 = 3 then 'clock' else k end as kind from (select *, ['http', 'db', 'queue', 'clock', 'random'][o_orderkey % 5 + 1] as k from oc)),
    lab as (select repo, node, min(eo) as eo from met group by 1, 2),
    run as (select repo, scenario, seams, needs from placed where blocked is null),
    can as (select run.repo, scenario, so, target, in_id, kind, list_position(seams, kind) as kp from run join sea on sea.repo = run.repo and list_contains(seams, kind)
        union all select run.repo, scenario, so, target, in_id, kind, 0 from run join sea on sea.repo = run.repo where len(seams) = 0 and list_contains(needs, 'injectable') and inj),
    sco as (select * from (select can.*, row_number() over (partition by can.repo, scenario, target order by eo, kp, so) as r from can join lab on lab.repo = can.repo and node = in_id) where r = 1),
    cen as (select distinct sco.repo, scenario, rea.eo from sco join rea on rea.repo = sco.repo and node = in_id),
    fir as (select repo, min(eo) as eo from ent group by 1),
    ces as (select * from cen union all select run.repo, scenario, eo from run join fir using (repo) where (run.repo, scenario) not in (select (repo, scenario) from sco)),
    mac as (select 'n' || c_nationkey as repo, c_custkey as mo, 'c#' || c_custkey as machine, case when c_custkey % 7 = 0 then 0 else 1 + (c_custkey % 2 = 0)::int + (c_custkey % 5 = 0)::int end as score from customer where c_mktsegment = 'BUILDING' and c_acctbal > 9000 and c_custkey % 3 <> 0),
    bes as (select repo, machine from (select *, row_number() over (partition by repo order by score desc, mo) as r from mac) where r = 1)"""


@query(f"""{WALK_SQL},
    ns as (select repo, scenario, count(*) as n_seams from sco group by 1, 2), ne as (select repo, scenario, count(*) as n_entries, min(eo) as eo from ces group by 1, 2),
    hom as (select ne.*, dir from ne left join nod on nod.repo = ne.repo and id = 's#' || eo)
    select p.repo, p.scenario, 'Test' || array_to_string(list_transform(string_split(lower(p.scenario), '-'), lambda x: upper(x[1]) || x[2:]), '') as func_name, p.severity, technique, size, blocked, coalesce(n_seams, 0) as n_seams, coalesce(n_entries, 0) as n_entries,
        case when blocked is null and list_contains(needs, 'machine') then machine end as machine, case when blocked is null and list_contains(needs, 'tenant') then p.repo || '_id' end as tenancy, case when blocked is null and list_contains(needs, 'hash_chain') then p.repo || '_chain' end as hash_chain,
        case when blocked is null then case when n_entries > 0 then 's' else '' end end as target_pkg, case when blocked is null then coalesce(dir, '.') || '/' || family || case when size = 'small' then '_test.go' else '_integration_test.go' end end as target_file, place
    from placed p left join ns using (repo, scenario) left join hom using (repo, scenario) left join bes on bes.repo = p.repo""")
def selected_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The complete cases of each nation: technique, size, how many seams and entries, machine, function and file, in order."""
    cases = payments.selected(walked_flow(spark, sf))["cases"]
    return cases.select("repo", "scenario", "func_name", "severity", "technique", "size", "blocked", "n_seams", "n_entries", "machine", "tenancy", "hash_chain", "target_pkg", "target_file", F.col("place").cast("long").alias("place"))


@query(f"{WALK_SQL} select repo, scenario, target, in_id, kind, so as seam from sco")
def case_seams(spark: SparkSession, sf: str) -> DataFrame:
    """The seams of each runnable case: of each target that the entries reach the first."""
    return payments.selected(walked_flow(spark, sf))["seams"].select("repo", "scenario", "target", "in_id", "kind", F.col("ord").alias("seam"))


@query(f"{WALK_SQL} select repo, scenario, eo as entry_ord from ces")
def case_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entries from which the seams of each runnable case are reached; the first entry of a case without seams."""
    return payments.selected(walked_flow(spark, sf))["entries"]


@query(f"{WALK_SQL} select repo, node, eo as entry_ord from lab")
def least_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The first entry that reaches each node of a nation's calls."""
    t = walked_flow(spark, sf)
    return graph.least_entry(t["edges"], t["nodes"], t["entries"])


ASK_KINDS = ["moneyModel", "mainEntity", "questions", "other", "externalEffect", "stateRoles"]
#: What the asks of a nation may cost; every fifth nation has no limit.
BUDGET = 60_000

ASKS_SQL = f"""{WALK_SQL},
    d as (select repo, count(*) filter (where blocked is null) as runnable, bool_or(blocked is null and list_contains(needs, 'key')) as key, bool_or(blocked is null and list_has_any(needs, ['money', 'transfer', 'balance', 'key'])) as money, count(*) filter (where blocked is null and list_contains(needs, 'machine')) as need_machine from placed group by 1),
    seamed as (select repo, target as subject, count(distinct scenario) as worth from sco group by 1, 2), stated as (select repo, machine as subject, true as is_machine from mac),
    a as (select 'n' || c_nationkey as repo, o_orderkey as ord, {_quoted(ASK_KINDS)}[o_orderkey % 6 + 1] as kind, case o_orderkey % 6 when 4 then 't' || ((o_orderkey // 6) % 120) when 5 then 'c#' || o_custkey else '' end as subject,
        strlen(o_orderpriority) * (o_orderkey % 9 + 1) as bytes, case when (o_orderkey // 6) % 3 = 0 and o_orderkey % 6 in (2, 3) then 99 else 0 end as output, o_orderstatus = 'F' as settled, c_nationkey as n from orders join customer on o_custkey = c_custkey),
    f as (select a.*, runnable, case when is_machine then need_machine else 0 end as machines, case kind when 'moneyModel' then 10 when 'mainEntity' then 8 when 'questions' then 2 when 'externalEffect' then 5 when 'stateRoles' then 2 end as fields, case kind when 'mainEntity' then 5 when 'moneyModel' then 10 when 'questions' then 2 when 'externalEffect' then 5 when 'stateRoles' then 2 end as live,
        case when kind = 'externalEffect' and worth is null then 'seam not in demand' when kind = 'stateRoles' and coalesce(case when is_machine then need_machine end, 0) = 0 then 'machine not in demand' when kind = 'moneyModel' and not coalesce(money, false) then 'money model not in demand' when kind = 'mainEntity' and not coalesce(key, false) then 'key not in demand' end as skip,
        case kind when 'moneyModel' then 77 when 'mainEntity' then 128 when 'externalEffect' then 21 when 'stateRoles' then 131 else 40 end as per,
        case kind when 'externalEffect' then worth when 'stateRoles' then case when is_machine then need_machine end when 'moneyModel' then runnable when 'mainEntity' then runnable else 1 end as raw from a left join d using (repo) left join seamed using (repo, subject) left join stated using (repo, subject)),
    w as (select *, skip is null as on_, case when skip is not null then 'skip' when kind = 'externalEffect' or kind = 'moneyModel' and settled then 'verify' else 'open' end as m, case when skip is not null then 1 else coalesce(raw, 1) end as value from f),
    decided as (select repo, n, ord, kind, m as method, coalesce(skip, case when kind = 'other' then 'not registered' else live || ' fields read' end) as why, on_ as chosen, cast(value as bigint) as value, case when on_ then bytes // 4 else 0 end as input,
        case when not on_ then 0 when kind <> 'other' and output > 0 then output when m = 'verify' then 5 * fields else per * coalesce(fields, 1) end as output, bytes // 4 + 5 * per * coalesce(fields, 1) as asked, case when on_ and output = 0 and kind = 'mainEntity' then 3 * 128 else 0 end as trimmable from w),
    priced as (select *, input + 5 * output as weighted, case when n % 5 = 0 then 0 else {BUDGET} end as budget from decided),
    q as (select *, row_number() over (partition by repo order by not chosen, -(case when weighted = 0 then 0.0 else value::double / weighted * 1000 end), ord) as place from priced)"""
#: First-fit as a walk over the places of each nation.
PLAN_SQL = (
    ASKS_SQL
    + """,
    g as (select repo, place, case when chosen and (budget = 0 or weighted <= budget) then weighted else 0 end as spent, budget = 0 or case when chosen then weighted else 0 end <= budget as taken from q where place = 1
        union all select q.repo, q.place, g.spent + case when q.chosen and (q.budget = 0 or g.spent + q.weighted <= q.budget) then q.weighted else 0 end, q.budget = 0 or g.spent + case when q.chosen then q.weighted else 0 end <= q.budget from g join q on q.repo = g.repo and q.place = g.place + 1),
    plan as (select q.* replace (q.chosen and taken as chosen, case when q.chosen and not taken then 'skip' else method end as method), q.chosen and not taken as over from q join g using (repo, place))"""
)


def planned_asks(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as an ask of its nation, decided by what its runnable cases call for, and planned within a budget."""
    flow = walked_flow(spark, sf)
    selected = payments.selected(flow)
    cases = checkpointed(selected["cases"].select("repo", "scenario", "technique", "runnable", "requires"))  # a row for each repo and scenario
    by_seam = selected["seams"].groupBy("repo", "target").agg(F.array_sort(F.collect_set("scenario")).alias("scenarios"))
    customers = read(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("repo"), F.col("c_custkey").alias("o_custkey"))
    key = F.col("o_orderkey")
    of = lambda names, at: F.element_at(F.array(*[F.lit(k) for k in names]), (at + 1).cast("int"))
    turn = F.floor(key / 6)
    subject = F.when(key % 6 == 4, F.concat(F.lit("t"), turn % 120)).when(key % 6 == 5, F.concat(F.lit("c#"), "o_custkey")).otherwise("")
    output = F.when((turn % 3 == 0) & (key % 6).isin(2, 3), 99).otherwise(0)
    asks = read(spark, sf, "orders").join(customers, "o_custkey").select("repo", key.alias("ord"), of(ASK_KINDS, key % 6).alias("kind"), subject.alias("subject"), F.expr("repeat(o_orderpriority, cast(o_orderkey % 9 + 1 as int))").alias("prompt"), F.lit(0).alias("asks"), output.alias("output"), (F.col("o_orderstatus") == "F").alias("settled"))
    choices = payments.decided(asks, rollups.demand(cases), by_seam, rollups.states_demanded(cases, flow["machines"]))
    budgets = read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("repo"), F.when(F.col("n_nationkey") % 5 == 0, 0).otherwise(BUDGET).alias("budget"))
    return payments.planned(choices, budgets)


@query(f"{PLAN_SQL} select repo, ord, kind, method, chosen, over, case when over then 'over the budget' else why end as why, weighted, value, place from plan")
def ask_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Which asks the runnable cases of each nation call for, what they cost and are worth, and which the budget passes over."""
    plan = planned_asks(spark, sf)
    over = F.startswith("why", F.lit("over the budget"))
    return plan.select("repo", "ord", "kind", "method", "chosen", over.alias("over"), F.when(over, "over the budget").otherwise(F.col("why")).alias("why"), F.col("weighted").cast("long").alias("weighted"), "value", "place")


@query(f"""{PLAN_SQL}, sums as (select repo, coalesce(sum(weighted) filter (where chosen), 0)::bigint as total, coalesce(sum(asked) filter (where not chosen), 0)::bigint as avoided from plan group by 1)
    select repo, total, avoided, cast(case when total + avoided = 0 then 0 else round_even(100 * avoided::double / (total + avoided)::double, 0) end as bigint) as saved_percent from sums""")
def plan_report(spark: SparkSession, sf: str) -> DataFrame:
    """What each nation's plan costs, what the asks it leaves out would have, and the share saved."""
    return rollups.plan_totals(planned_asks(spark, sf), ["repo"])


@query(f"{PLAN_SQL} select repo, kind, case when over then 'over the budget' else why end as why, count(*) as n from plan where not chosen group by 1, 2, 3")
def explained_skips(spark: SparkSession, sf: str) -> DataFrame:
    """The asks that each nation's plan leaves out, by kind and reason."""
    over = F.startswith("why", F.lit("over the budget"))
    plan = planned_asks(spark, sf).withColumn("why", F.when(over, "over the budget").otherwise(F.col("why")))
    return rollups.explained(plan)["skipped"]


@query(f"{PLAN_SQL} select repo, kind, cast(sum(trimmable) as bigint) as trimmable from plan where chosen and trimmable > 0 group by 1, 2")
def explained_trims(spark: SparkSession, sf: str) -> DataFrame:
    """Output tokens of fields that are paid for and not read, by kind."""
    return rollups.explained(planned_asks(spark, sf))["trimmable"]


@query("""
    with m as (select o_custkey as repo, o_orderpriority as type, min(o_orderkey) as ord, list_distinct(list(o_orderstatus)) as states, bool_or(o_totalprice > 100000) as asked,
        bool_or(o_totalprice > 100000 and o_orderstatus = 'O' and o_orderpriority <> '5-LOW') as init, bool_or(o_totalprice > 100000 and o_orderstatus = 'F' and o_orderpriority <> '5-LOW') as fin from orders group by 1, 2),
    s as (select *, case when not asked then 0 else 1 + init::int + fin::int end as score from m where len(states) >= 2)
    select repo, type, cast(score as int) as score from (select *, row_number() over (partition by repo order by score desc, ord) as r from s) where r = 1""")
def best_machine(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's order priorities as state machines: of those with two statuses or more the one that is best known."""
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("type"), "o_orderkey", "o_orderstatus", "o_totalprice")
    machines = orders.groupBy("repo", "type").agg(F.min("o_orderkey").alias("ord"), F.collect_set("o_orderstatus").alias("states"))
    role = F.struct((F.col("o_orderstatus") == "O").alias("initializing"), (F.col("o_orderstatus") == "F").alias("final"), (F.col("type") == "5-LOW").alias("foreign"))
    roles = orders.where("o_totalprice > 100000").groupBy("repo", "type").agg(F.collect_set(role).alias("roles"))
    return payments.best_machine(machines, roles)


def _words(test: str) -> list[tuple[str, list[str]]]:
    """(sort, words) of the parts of a signal's test."""
    return [(kind, names.split()) for a in test.split(" or ") for part in a.split("&") for kind, _, names in [part.strip().lstrip("!").partition(":")] if names]


def _vocabulary(sort: str) -> list[str]:
    return sorted({w for *_, test in dims.rows(dims.SIGNALS) for kind, words in _words(test) if kind == sort for w in words})


VOCABULARY = {sort: _vocabulary(sort) for sort in ("table", "column", "symbol", "state")}


def _signal_sql(test: str) -> str:
    def one(part: str) -> str:
        part = part.strip()
        if part == "currencies":
            return "currencies > 1"
        kind, _, names = part.lstrip("!").partition(":")
        words = names.split()
        if kind == "table":
            found = f"(list_has_any(tables, {_quoted(words)}) or list_has_any(fields, {_quoted([*words, *[w.removesuffix('s') for w in words]])}))"
        elif kind == "column":
            found = f"(list_has_any(columns, {_quoted(words)}) or list_has_any(fields, {_quoted(words)}))"
        else:
            blob = "array_to_string(states, ' ')" if kind == "state" else "symbols"
            found = "(" + " or ".join(f"contains({blob}, '{w}')" for w in words) + ")"
        return f"not {found}" if part.startswith("!") else found

    return " or ".join("(" + " and ".join(one(p) for p in alternative.split("&")) + ")" for alternative in test.split(" or "))


def _kinds_sql(currencies: str = "count(distinct o_orderpriority) - 3") -> str:
    pick = lambda sort, by: f"{_quoted(VOCABULARY[sort])}[(o_orderkey // {by}) % {len(VOCABULARY[sort])} + 1]"
    score = lambda axis, kind: " + ".join([f"case when {_signal_sql(test)} then {w} else 0 end" for a, k, w, test in dims.rows(dims.SIGNALS) if (a, k) == (axis, kind)])
    names = list(dict.fromkeys((a, k) for a, k, _, _ in dims.rows(dims.SIGNALS)))
    scores = ", ".join(f"{score(a, k)} as s_{k}" for a, k in names)
    listed = lambda axis, least: "list_transform(list_sort([" + ", ".join(f"case when s_{k} >= {least} then {{'s': -s_{k}, 'k': '{k}'}} end" for a, k in names if a == axis) + "]), lambda x: x.k)"
    cut = lambda x: f"list_filter({x}, lambda x: x is not null)"
    return f"""
        with f as (select o_custkey as repo, list_distinct(list({pick("table", 1)}) filter (where o_orderstatus = 'F')) as tables, list_distinct(list({pick("column", 3)}) filter (where o_orderpriority < '3')) as columns, list_distinct(list({pick("table", 5)}) filter (where o_totalprice > 350000)) as fields,
            list_distinct(list({pick("state", 2)}) filter (where o_orderpriority = '5-LOW' and o_orderkey % 4 = 0)) as states, array_to_string(list({pick("symbol", 2)}) filter (where o_orderstatus = 'P'), ' ') as symbols, {currencies} as currencies, bool_or(o_totalprice < 20000) as stateful from orders group by 1),
        g as (select repo, coalesce(tables, []) as tables, coalesce(columns, []) as columns, coalesce(fields, []) as fields, coalesce(states, []) as states, coalesce(symbols, '') as symbols, currencies, stateful from f),
        s as (select repo, stateful, {scores} from g), m as (select *, {cut(listed("motion", 4))} as ms, {cut(listed("overlay", 1))} as os from s)
        select repo, case when s_double_entry = 0 and s_wallet = 0 then 'stateless' when s_double_entry > s_wallet then 'double_entry' else 'wallet' end as spine,
            (s_double_entry < s_wallet + 2 and s_wallet < s_double_entry + 2) and (s_double_entry > 0 or s_wallet > 0) as unsure, case when len(ms) = 0 and stateful then ['one_shot'] else ms end as motions, os as overlays from m"""


@query(_kinds_sql())
def payment_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of each customer, whose orders are read as names of tables, columns, fields, states and symbols."""
    key = F.col("o_orderkey")
    pick = lambda sort, by: F.element_at(F.array(*[F.lit(w) for w in VOCABULARY[sort]]), (F.floor(key / by) % len(VOCABULARY[sort]) + 1).cast("int"))
    some = lambda cond, name: F.collect_set(F.when(F.expr(cond), name))
    facts = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(
        some("o_orderstatus = 'F'", pick("table", 1)).alias("tables"), some("o_orderpriority < '3'", pick("column", 3)).alias("columns"), some("o_totalprice > 350000", pick("table", 5)).alias("fields"),
        some("o_orderpriority = '5-LOW' and o_orderkey % 4 = 0", pick("state", 2)).alias("states"), F.array_join(some("o_orderstatus = 'P'", pick("symbol", 2)), " ").alias("symbols"),
        (F.count_distinct("o_orderpriority") - 3).alias("currencies"), F.bool_or(F.col("o_totalprice") < 20000).alias("stateful"),
    )
    return payments.classified(facts, facts.where("stateful"))


@query(_kinds_sql("count(distinct o_orderpriority) filter (where o_orderpriority < '3')"))
def payment_kinds_by_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of each customer, from the names in its orders a row each, without gathering them."""
    key = F.col("o_orderkey")
    orders = read(spark, sf, "orders").withColumn("repo", F.col("o_custkey"))
    pick = lambda sort, by: F.element_at(F.array(*[F.lit(w) for w in VOCABULARY[sort]]), (F.floor(key / by) % len(VOCABULARY[sort]) + 1).cast("int"))
    some = lambda cond, value, name: orders.where(cond).select("repo", value.alias(name))
    money = F.when(F.col("o_orderpriority") == "1-URGENT", "USD").when(F.col("o_orderpriority") == "2-HIGH", "EUR").otherwise("coins")
    rows = payments.facts_as_rows(
        some("o_orderstatus = 'F'", pick("table", 1), "table"), some("o_orderpriority < '3'", pick("column", 3), "column"), some("o_totalprice > 350000", pick("table", 5), "field"),
        some("o_orderstatus = 'P'", pick("symbol", 2), "symbol"), some("o_orderpriority = '5-LOW' and o_orderkey % 4 = 0", pick("state", 2), "state"), some("true", money, "value"),
    )
    return payments.classified_rows(rows, orders.where("o_totalprice < 20000"), orders)


def supplier_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per nation a call graph: its suppliers and the parts of their lines call each other, in the order of the lines.

    Suppliers are the entries by number; some nations have none.
    """
    owner = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("n"), "s_nationkey").alias("repo"), "s_nationkey")
    # Keys are grouped as numbers and become names where they are read.
    lines = read(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("first"))
    pairs = checkpointed(lines.join(owner.select("l_suppkey", "repo").distinct(), "l_suppkey"))  # nodes and edges are both made of them
    s, p = F.concat(F.lit("s#"), "l_suppkey"), F.concat(F.lit("p#"), "l_partkey")
    edges = pairs.select("repo", s.alias("src"), p.alias("dst"), F.col("first").alias("ord")).unionByName(pairs.select("repo", p.alias("src"), s.alias("dst"), F.col("l_suppkey").cast("long").alias("ord")))
    nodes = pairs.select("repo", "l_suppkey").distinct().select("repo", s.alias("id")).unionByName(pairs.select("repo", "l_partkey").distinct().select("repo", p.alias("id")))
    entries = owner.where("s_nationkey % 5 <> 0").select("repo", F.col("l_suppkey").cast("int").alias("ord"), F.lit("s").alias("pkg"), F.col("l_suppkey").cast("string").alias("symbol"))
    return nodes, entries, edges


@query("""
    with recursive e as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem), b as (select src, dst from e union all select dst, src from e),
    r as (select s_nationkey as entry, 's' || s_suppkey as node, 0 as depth from supplier union select r.entry, b.dst, r.depth + 1 from r join b on b.src = r.node where r.depth < 9)
    select entry, node, min(depth) as depth from r group by 1, 2""")
def reachability(spark: SparkSession, sf: str) -> DataFrame:
    """What the suppliers of each nation reach over all pairs of supplier and part, to the end; the least depth."""
    e = read(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst")).distinct()
    e = checkpointed(e)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seeds = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("entry"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("node"))
    return graph.reachable(both, seeds, ["entry"])


@query("""
    with recursive l as (select distinct 'n' || s_nationkey as repo, s_nationkey as n, 's#' || l_suppkey as s, 'p#' || l_partkey as p from lineitem join supplier on s_suppkey = l_suppkey),
    b as (select repo, s as src, p as dst from l union all select repo, p, s from l),
    r as (select 'n' || s_nationkey as repo, cast(s_suppkey as int) as entry_ord, 's#' || s_suppkey as node from supplier where s_nationkey % 5 <> 0 union select r.repo, r.entry_ord, b.dst from r join b on b.repo = r.repo and b.src = r.node)
    select repo, entry_ord, node from r union all select repo, 0, node from (select repo, s as node, n from l union select repo, p, n from l) where n % 5 = 0""")
def reach_sets(spark: SparkSession, sf: str) -> DataFrame:
    """What each supplier reaches within its nation; a nation without entries has one set of all its nodes."""
    return graph.reach_sets(*supplier_graph(spark, sf))


@query()
def call_preorder(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation: suppliers and parts in the order in which a walk from each supplier first meets them."""
    return graph.preorder(*supplier_graph(spark, sf))
