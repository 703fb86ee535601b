"""Registered queries of the smaller rules: predicates, texts, answers, diagrams and facts, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import text, tristate
from ledgerlens.operators import graph, joins, predicates, ranking, rollups, sets, state, validation
from ledgerlens.plans import dims
from ledgerlens.plans.flow_queries import ASK_KINDS, PLAN_SQL, SEAM_KINDS, flow_cases, supplier_graph
from ledgerlens.plans.registry import query, read


def picked(names: list[str], at: Column) -> Column:
    """The name at a number, which is taken round."""
    return F.element_at(F.array(*[F.lit(x) for x in names]), (at % len(names) + 1).cast("int"))


def listed(names: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


@query(f"select distinct o_custkey as repo, o_orderpriority as target from orders where ({listed(SEAM_KINDS)})[o_orderkey % 5 + 1] not in ('clock', 'random')")
def askable_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The priorities of each customer's orders, as boundaries of a kind that can be asked about."""
    return predicates.askable_targets(read(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), picked(SEAM_KINDS, F.col("o_orderkey")).alias("kind"), F.col("o_orderpriority").alias("target")))


@query("""
    with c as (select p_brand as repo, case when p_size % 2 = 0 then 'money' else 'idempotency' end as role, p_partkey, p_name, p_type, p_size from part where p_retailprice > 905),
    f as (select * from (select *, row_number() over (partition by repo, role order by p_partkey) as r from c) where r = 1),
    m as (select repo, p_type || '.' || p_name as money_type, p_name as amount_field, ['minor_units_int', 'float', 'decimal'][p_size % 3 + 1] as representation from f where role = 'money'),
    k as (select f.repo, p_name as idempotency_key, case when exists (select 1 from part p where p.p_brand = f.repo and p.p_size > 40 and p.p_name = f.p_name) then 'db_constraint' when exists (select 1 from part p where p.p_brand = f.repo and p.p_size = 7) then 'app_check_then_write' else 'unknown' end as uniqueness from f where role = 'idempotency')
    select coalesce(m.repo, k.repo) as repo, money_type, amount_field, representation, idempotency_key, uniqueness from m full join k on m.repo = k.repo""")
def settled_by_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a brand as candidates for its money field and key; large ones have a constraint, and size 7 stands for migrations."""
    part = read(spark, sf, "part")
    kind = picked(["int64", "float64", "decimal"], F.col("p_size"))
    cand = part.select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 2 == 0, "money").otherwise("idempotency").alias("role"), F.col("p_name").alias("name"), F.col("p_type").alias("owner"), kind.alias("type"), (F.col("p_retailprice") > 905).alias("decided"))
    unique = part.where("p_size > 40").select(F.col("p_brand").alias("repo"), F.lit("unique").alias("kind"), F.array(F.upper("p_name")).alias("columns"))
    return predicates.scan_answers(cand, unique, part.where("p_size = 7").select(F.col("p_brand").alias("repo")))


@query("""
    with q as (select *, case p_partkey % 3 when 0 then p_type || '.a' when 1 then 'technique.' || p_brand || '.b' else p_name end as question, case p_size % 3 when 0 then null else p_size % 3 = 1 end as passed from part)
    select p_partkey, not (p_size % 3 = 0 or (p_size % 3 = 1 and p_size % 4 < 2)) as asked, starts_with(question, p_type || '.') or starts_with(question, 'technique.' || p_brand || '.') as own, case when p_size < 25 then '' else 'integration' end as tag, p_size % 2 = 1 as finds,
        coalesce(passed, false) as green, coalesce(not passed, false) as red, p_type in ('PROMO', 'ECONOMY') and not (p_size > 30 and p_type = 'PROMO') as final, p_size % 2 = 0 as same from q""")
def small_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """The one-row predicates over parts."""
    k, size = F.col("p_partkey"), F.col("p_size")
    question = F.when(k % 3 == 0, F.concat("p_type", F.lit(".a"))).when(k % 3 == 1, F.concat(F.lit("technique."), "p_brand", F.lit(".b"))).otherwise(F.col("p_name"))
    passed = F.when(size % 3 != 0, size % 3 == 1)
    left = F.when(size > 30, F.array(F.lit("PROMO"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf, "part").select(
        k, predicates.entity_question(size % 3, size % 4).alias("asked"), predicates.sees_own_answer(question, F.col("p_type"), F.col("p_brand")).alias("own"), predicates.build_tag(F.when(size < 25, "small").otherwise("medium")).alias("tag"), predicates.can_find_bugs(F.when(size % 2 == 0, "currentBehavior").otherwise("invariant")).alias("finds"),
        tristate.green(passed).alias("green"), tristate.red(passed).alias("red"), state.is_final(F.col("p_type"), F.array(F.lit("PROMO"), F.lit("ECONOMY")), left).alias("final"), text.same_field(F.when(size % 2 == 0, F.upper("p_name")).otherwise(F.col("p_type")), F.col("p_name")).alias("same"),
    )


@query("""
    select p_partkey, case when p_size % 2 = 0 then p_type || '-' || replace(p_name, ' ', '-') else p_type end as id, case when p_size % 3 = 0 then '.' else p_brand end || '/' || lower(p_type) || case when p_size < 25 then '_test.go' else '_integration_test.go' end as file,
        case when p_size % 2 = 0 then p_type || ': ' else '' end || p_name || case when p_size < 25 then ' Answer true or false.' else ' Answer in words.' end as question, case when p_size % 4 = 3 then p_name || ' and ' || p_type else p_name end as clause,
        case when strlen(p_name) > 8 then left(p_name, 8) || chr(10) || '… truncated' else p_name end as capped, case when p_size % 2 = 0 then p_name || chr(10) || p_type else p_type end as body, '  ' || p_name || chr(10) || '  ' || p_type as indented, case when p_size % 2 = 0 then [p_type, p_brand] else [p_type, p_brand, p_name] end as once from part""")
def ask_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of asks over parts: ids, files, questions, clauses, caps, titles and indents."""
    size, name, kind, even = F.col("p_size"), F.col("p_name"), F.col("p_type"), F.col("p_size") % 2 == 0
    joined = F.concat(name, picked([" — ", ", so ", " with ", " and "], size), kind)
    two = F.concat(name, F.lit("\n"), kind)
    once = sets.append_once(F.array("p_type", "p_brand"), F.when(even, kind).otherwise(name))
    return read(spark, sf, "part").select(
        "p_partkey", text.ask_id(kind, F.when(even, name)).alias("id"), text.target_file(F.when(size % 3 == 0, "").otherwise(F.col("p_brand")), kind, F.when(size < 25, "small").otherwise("medium")).alias("file"), text.question_text(F.when(even, kind), name, size < 25).alias("question"),
        text.first_clause(joined).alias("clause"), text.capped(name, 8).alias("capped"), text.strip_title(F.when(even, two).otherwise(F.concat(F.lit("# "), two))).alias("body"), text.indent(two, "  ").alias("indented"), once.alias("once"),
    )


EVIDENCE = [(f, e[1:], i.split()) for f, _, es, i in dims.rows(dims.FEATURES) for e in es.split()]


@query(f"""{PLAN_SQL}, ev(i, feature, question, informs) as (values {", ".join(f"({k}, '{f}', '{q}', {listed(i)}::varchar[])" for k, (f, q, i) in enumerate(EVIDENCE))}),
    mk as (select distinct 'n' || c_nationkey as repo, feature, question from orders join customer on c_custkey = o_custkey join ev on i = o_orderkey % {len(EVIDENCE)} where o_orderstatus = 'P'),
    fi as (select distinct feature, unnest(informs) as scenario from ev)
    select distinct pl.repo, pl.scenario as case_id, fi.feature from placed pl join fi using (scenario) join mk on mk.repo = pl.repo and mk.feature = fi.feature
    where pl.blocked is null and not starts_with(mk.question, pl.scenario || '.') and not starts_with(mk.question, 'technique.' || pl.technique || '.')""")
def case_conclusions(spark: SparkSession, sf: str) -> DataFrame:
    """For each nation's runnable cases the features with marks from its partial orders that are not the case's own answers."""
    cases = flow_cases(spark, sf).where("blocked is null").select("repo", F.col("scenario").alias("case_id"), "scenario", "technique")
    evidence = dims.evidence(spark)
    rows = spark.createDataFrame([(k, f, q) for k, (f, q, _) in enumerate(EVIDENCE)], "i int, feature string, question string")
    nation = read(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("repo"), F.col("c_custkey").alias("o_custkey"))
    partial = read(spark, sf, "orders").where("o_orderstatus = 'P'").join(nation, "o_custkey").select("repo", (F.col("o_orderkey") % len(EVIDENCE)).cast("int").alias("i"))
    marks = partial.join(F.broadcast(rows), "i").select("repo", "feature", "question").distinct()
    return joins.case_conclusions(cases, evidence.select("feature", "informs").distinct(), marks)


@query("""
    with o as (select o_custkey as c, count(*) as n, max(o_totalprice) as top from orders group by 1)
    select c_custkey, o.n as orders, o.top as top, n_name as nation, r_name as region from customer left join o on c = c_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey""")
def customer_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with what is known of their orders, nation and region; null where nothing is."""
    cases = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    nation = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return joins.with_facts(cases, {"orders": (orders, ["c_custkey"]), "place": (nation, ["c_nationkey"])}).select("c_custkey", F.col("orders.n").alias("orders"), "orders.top", F.col("place.n_name").alias("nation"), F.col("place.r_name").alias("region"))


@query("""
    with c as (select c_nationkey as repo, list_sort(list_distinct(list(lower(c_mktsegment)))) as tables, list_sort(list_distinct(list('col' || c_custkey % 7))) as columns from customer group by 1),
    s as (select s_nationkey as repo, list_sort(list_distinct(list('traceid' || s_suppkey % 3) || list('trace_i_d' || s_suppkey % 3))) as fields, array_to_string(list_sort(list_distinct(list(lower(s_name)))), ' ') as symbols from supplier group by 1),
    o as (select c_nationkey as repo, list_sort(list_distinct(list('S' || o_orderstatus))) as states, count(distinct substr(o_orderpriority, 3, 3)) as currencies from orders join customer on c_custkey = o_custkey group by 1)
    select coalesce(c.repo, s.repo, o.repo) as repo, coalesce(tables, []) as tables, coalesce(columns, []) as columns, coalesce(fields, []) as fields, coalesce(states, []) as states, coalesce(symbols, '') as symbols, coalesce(currencies, 0) as currencies from c full join s on c.repo = s.repo full join o on o.repo = coalesce(c.repo, s.repo)""")
def gathered_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What the customers, suppliers and orders of a nation say of its tables, fields, states and currencies."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("repo"), "c_custkey", "c_mktsegment")
    s = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("repo"), "s_name", F.concat(F.lit("TraceID"), F.col("s_suppkey") % 3).alias("field"))
    o = read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("repo", F.concat(F.lit("s"), "o_orderstatus").alias("state"), F.substring("o_orderpriority", 3, 3).alias("value"))
    return rollups.gathered(c.select("repo", F.col("c_mktsegment").alias("table")), c.select("repo", F.concat(F.lit("Col"), F.col("c_custkey") % 7).alias("column")), s.select("repo", "field"), s.select("repo", F.col("s_name").alias("symbol")), o.select("repo", "state"), o.select("repo", "value"))


@query(f"""
    with f as (select unnest([{", ".join(f"{{'k': '{p.split('.')[0]}', 'p': '{p}', 'u': '{u}'}}" for p, u in dims.rows(dims.FIELDS))}]) as f), k as (select f.k as kind, list_sort(list(f.p)) as fields, coalesce(list_sort(list(f.p) filter (where f.u = 'live')), []) as live from f group by 1),
    a as (select ({listed(ASK_KINDS)})[o_orderkey % 6 + 1] as kind, count(*) as asks from orders group by 1) select kind, asks, fields, live from a left join k using (kind)""")
def fields_asked(spark: SparkSession, sf: str) -> DataFrame:
    """How many orders ask for each kind of answer, with its fields and those that are read."""
    asks = read(spark, sf, "orders").groupBy(picked(ASK_KINDS, F.col("o_orderkey")).alias("kind")).agg(F.count(F.lit(1)).alias("asks"))
    return asks.join(F.broadcast(rollups.fields_of(dims.answer_fields(spark))), "kind", "left").select("kind", "asks", "fields", "live")


CHART_SQL = """
    with l as (select distinct s_nationkey as n, l_suppkey as s, l_partkey as p from lineitem join supplier on s_suppkey = l_suppkey),
    t as (select n, '  s_' || s || '["' || s || '"]' as t from l union select n, '  p_' || p || '["' || p || '"]' from l union select n, '  s_' || s || ' --> p_' || p from l union select n, '  p_' || p || ' --> s_' || s from l
        union select s_nationkey, '  s_' || s_suppkey || ' -.-> ' || replace(s_name, '#', '_') from supplier where s_acctbal <= 0)"""
STATE_SQL = """
    with w as (select distinct c_nationkey as repo, o_orderpriority as type, o_orderstatus as s, c_custkey % 5 as f from orders join customer on c_custkey = o_custkey where o_orderstatus <> 'P'), t as (select distinct repo, '  [*] --> S_' || s || ': fn' || f as t from w)"""


def supplier_chart(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and seams of each nation's suppliers and parts; suppliers in debt have a boundary that cannot be replaced."""
    nodes, _, edges = supplier_graph(spark, sf)
    seams = read(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("repo"), F.concat(F.lit("s#"), "s_suppkey").alias("in_id"), F.col("s_name").alias("target"), (F.col("s_acctbal") > 0).alias("injectable"))
    return nodes.withColumn("symbol", F.substring_index("id", "#", -1)), edges, seams


@query(f"{CHART_SQL} select 'n' || n as repo, 'flowchart TD' || chr(10) || string_agg(t, chr(10) order by t) as diagram from t group by 1")
def flowcharts(spark: SparkSession, sf: str) -> DataFrame:
    """A chart of each nation's suppliers and parts in one text."""
    return graph.flowchart(*supplier_chart(spark, sf))


@query(f"{CHART_SQL} select 'n' || n as repo, row_number() over (partition by n order by t) as line, t as text from t union all select distinct 'n' || n, 0, 'flowchart TD' from t")
def flowchart_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same charts as numbered lines, in which no row or task holds a nation's graph."""
    return graph.flowchart_lines(*supplier_chart(spark, sf))


def order_writes(spark: SparkSession, sf: str) -> DataFrame:
    """The statuses that the orders of a nation are written with; partial ones are dynamic."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_custkey").alias("o_custkey"))
    to = F.when(F.col("o_orderstatus") == "P", "<dynamic>").otherwise(F.concat(F.lit("S."), "o_orderstatus"))
    return read(spark, sf, "orders").join(c, "o_custkey").select("repo", F.col("o_orderpriority").alias("type"), to.alias("to"), F.concat(F.lit("pkg#fn"), F.col("o_custkey") % 5).alias("in_id"))


@query(f"{STATE_SQL} select repo, 'stateDiagram-v2' || chr(10) || string_agg(t, chr(10) order by t) as diagram from t group by 1")
def state_diagrams(spark: SparkSession, sf: str) -> DataFrame:
    """A diagram of the statuses of each nation's orders in one text."""
    return graph.state_diagram(order_writes(spark, sf))


@query(f"{STATE_SQL} select repo, row_number() over (partition by repo order by t) as line, t as text from t union all select distinct repo, 0, 'stateDiagram-v2' from t")
def state_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same diagrams as numbered lines."""
    return graph.state_lines(order_writes(spark, sf))


KINDS = list(dict.fromkeys((k, s) for _, k, s in dims.rows(dims.KIND_SCENARIOS)))


@query(f"""
    with k(i, scenarios) as (values {", ".join(f"({n}, {listed(s.split())})" for n, (_, s) in enumerate(KINDS))})
    select distinct o_custkey as repo, unnest(scenarios) as scenario from orders join k on i = o_orderkey % {len(KINDS)} where o_orderpriority = '1-URGENT'""")
def scenarios_of_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The scenarios of the kinds that each customer's urgent orders stand for."""
    kinds = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("repo"), picked([k for k, _ in KINDS], F.col("o_orderkey")).alias("kind"))
    return sets.kind_scenarios(kinds, F.broadcast(dims.kind_scenarios(spark)))


@query("""
    with o as (select user_id, event_id, event_type, value, lead(event_type) over (partition by user_id order by event_id) as nxt from events)
    select distinct user_id as machine, event_type as src, nxt as dst from o where nxt is not null and (value > 50 or event_type = 'error')""")
def transitions_with_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    """What follows a user's dear events, and as exceptions what follows errors."""
    from pyspark.sql import Window

    e = read(spark, sf, "events").select(F.col("user_id").alias("machine"), F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("dst"), "value").where("dst is not null")
    return state.with_exceptions(e.where("value > 50").drop("value"), e.where("src = 'error'").drop("value"))


@query("""
    select o_orderkey, list_filter([case when o_orderstatus = 'F' and o_orderkey % 3 <> 0 then 'blocked without a reason' end, case when o_orderstatus = 'P' then 'unknown status' end, case when o_orderstatus = 'O' and o_orderkey % 5 = 0 then 'written without content' end,
        case when o_orderstatus = 'O' and o_orderkey % 5 <> 0 and o_orderkey % 2 = 0 then 'not a test file' end, case when o_orderstatus = 'O' and o_orderkey % 5 <> 0 and o_orderkey % 4 = 0 then 'no assertion' end, case when o_orderstatus = 'O' and o_orderkey % 5 <> 0 and o_totalprice > 200000 and o_orderpriority <> '1-URGENT' then 'no build tag' end], lambda x: x is not null) as case_problems,
        case when o_orderpriority < '3' and o_orderstatus = 'P' and o_orderkey % 3 <> 0 then ['no verdict and no reason for it'] when o_orderkey % 2 = 0 and o_orderstatus = 'F' and o_orderkey % 3 <> 0 then ['a rejected finding without a reason'] when o_orderpriority >= '3' and o_orderkey % 3 <> 0 then ['no answer'] else [] end as question_problems,
        case when o_orderstatus <> 'F' then 'found ' || o_orderstatus || ', x' end as shape from orders""")
def validate_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as answers to cases and questions: what is wrong with each."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "blocked").when(F.col("o_orderstatus") == "O", "written").otherwise("odd")
    reason = F.when(k % 3 == 0, "because")
    content = F.when(k % 5 != 0, F.when(F.col("o_orderpriority") == "1-URGENT", "//go:build integration").otherwise("body"))
    verdict = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O")
    return read(spark, sf, "orders").select(
        k, validation.case_answer(status, reason, content, F.when(k % 2 == 0, "x.go").otherwise("x_test.go"), F.when(k % 4 == 0, 0).otherwise(2), F.when(F.col("o_totalprice") > 200000, "medium").otherwise("small")).alias("case_problems"),
        validation.question_answer(F.col("o_orderpriority") < "3", verdict, reason, k % 2 == 0).alias("question_problems"), validation.shape_error(F.array("o_orderstatus", F.lit("x")), F.array(F.lit("F"))).alias("shape"),
    )


@query("""
    with s as (select c_nationkey as repo, list_distinct(list(c_mktsegment)) as states, list(c_mktsegment) filter (where c_acctbal < -900) as answered from customer group by 1)
    select repo, list_filter([case when len(list_distinct(coalesce(answered, []))) <> len(coalesce(answered, [])) then 'a state is answered twice' end, case when repo % 2 = 0 then 'a retry enters an undeclared state' end,
        case when len(list_distinct(coalesce(answered, []))) < len(states) then 'a declared state is missing' end, case when repo % 3 = 0 then 'an exception of an undeclared state' end], lambda x: x is not null) as problems from s""")
def validate_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Nations whose segments are states, answered by their deep debtors."""
    s = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("repo")).agg(F.collect_set("c_mktsegment").alias("states"), F.collect_list(F.when(F.col("c_acctbal") < -900, F.col("c_mktsegment"))).alias("answered"))
    none = F.array().cast("array<string>")
    retry = F.when(F.col("repo") % 2 == 0, F.array(F.lit("ABROAD"))).otherwise(none)
    odd = F.when(F.col("repo") % 3 == 0, F.array(F.struct(F.lit("ABROAD").alias("src"), F.lit("HOME").alias("dst"), F.lit("why").alias("why")))).otherwise(F.array().cast("array<struct<src:string,dst:string,why:string>>"))
    return s.select("repo", validation.state_roles(F.col("states"), F.col("answered"), retry, odd).alias("problems"))


@query("""
    select p_partkey, list_filter([case when p_size % 5 = 0 then 'no entity' end, case when p_size % 5 <> 0 and p_size % 2 = 0 then 'an entity without proof' end, case when p_size % 3 = 0 and p_size % 7 <> 0 then 'neither a key nor a reason for having none' end, case when p_size % 3 <> 0 and p_size % 4 = 0 then 'a key without proof' end,
        case when p_size % 3 <> 0 and p_size % 4 <> 0 and p_size > 40 then 'a generated key cannot be retried with' end, case when p_size % 3 <> 0 and p_type = 'PROMO' then 'the key is also listed as no key' end, case when p_size % 6 = 0 then 'an identifier without a purpose' end, case when p_size % 6 <> 0 and p_size > 25 then 'an identifier without a citation' end], lambda x: x is not null) as problems from part""")
def validate_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as answers about the main entity and its key."""
    size = F.col("p_size")
    other = F.struct(F.when(F.col("p_type") == "PROMO", F.upper("p_name")).otherwise(F.lit("other")).alias("field"), F.when(size % 6 != 0, "lookup").alias("purpose"), F.lit(False).alias("could_be_key"), (size <= 25).alias("cited"))
    checked = validation.main_entity(F.when(size % 5 != 0, F.col("p_type")), F.when(size % 2 != 0, "x.go:1"), F.when(size % 3 != 0, F.col("p_name")), F.when(size % 4 != 0, "x.go:2"), F.when(size % 7 == 0, "none"), F.when(size > 40, "generated").otherwise("caller"), F.array(other))
    return read(spark, sf, "part").select("p_partkey", checked.alias("problems"))


@query("select c_nationkey as repo, c_mktsegment as machine, case when c_acctbal < 0 then 'debt' else 'credit' end as state from customer group by all having count(*) > 1")
def unsettled_states(spark: SparkSession, sf: str) -> DataFrame:
    """Standings that several customers of a nation's segment share."""
    return validation.unsettled_states(read(spark, sf, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_mktsegment").alias("machine"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("state")))


@query("""
    with open as (select distinct c_nationkey as repo from customer where c_acctbal < -990) select o_orderkey as case_id, c_nationkey as repo from orders join customer on c_custkey = o_custkey where c_nationkey not in (select repo from open)""")
def gated_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of nations without a customer near the limit of debt, behind the gate that those would close."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    near = c.where("c_acctbal < -990").select("repo").distinct()
    cases = read(spark, sf, "orders").join(c, "o_custkey").select(F.col("o_orderkey").alias("case_id"), "repo").join(near, "repo", "left_anti")
    return state.gated(cases, near.withColumn("missing", F.array(F.lit("x")))).select("case_id", "repo")


@query("""
    with open as (select c_nationkey as repo, 'c' || c_custkey as name from customer where c_acctbal < -990 and c_custkey % 3 <> 0)
    select repo, count(*) as n_cases, any_value(missing) is not null as refused, any_value(missing[1:4]) as missing, cast(any_value(case when missing is not null then greatest(len(missing) - 4, 0) end) as bigint) as more
    from (select c_nationkey as repo from orders join customer on c_custkey = o_custkey) left join (select repo, list_sort(list(name)) as missing from open group by 1) using (repo) group by 1""")
def gate_report(spark: SparkSession, sf: str) -> DataFrame:
    """Which nations' second rounds are refused: those with customers near the limit of debt who have not answered (every third has), the first four of them named."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.concat(F.lit("c"), "c_custkey").alias("name"))
    near = c.where("c_acctbal < -990").select("repo", "name")
    answered = c.where("o_custkey % 3 = 0").select("repo", "name")
    cases = read(spark, sf, "orders").join(c, "o_custkey").select(F.col("o_orderkey").alias("case_id"), "repo")
    return state.gate_report(cases, joins.gate(near, answered, ["repo"], "name"))


@query("""
    with m as (select c_custkey as repo, c_mktsegment as money_type, case when c_custkey % 2 = 0 then 'Balance' end as bf, case when c_custkey % 3 = 0 then 'Move' end as tf, case when c_custkey % 5 > 0 then 'key' else '' end as ik, case when c_custkey % 4 = 0 then 'db_constraint' end as u from customer where c_acctbal > 0),
    r as (select o_custkey as repo, min(o_orderpriority) filter (where o_orderstatus = 'F') as symbol, list_sort(list_distinct(list('S' || (o_orderkey % 3)))) as skips from orders where o_orderkey % 4 = 0 group by 1)
    select coalesce(m.repo, r.repo) as repo, m.repo is not null or symbol is not null as known, coalesce(money_type, '') as money_type, coalesce(bf, '') as balance_func, coalesce(symbol, tf, '') as transfer_func, coalesce(ik, '') as idempotency_key, coalesce(u, '') as uniqueness,
        coalesce(list_transform(skips, lambda x: x || case x when 'S0' then ' no reason given' else ' by rule' end), []) as skipped from m full join r on m.repo = r.repo""")
def flow_facts(spark: SparkSession, sf: str) -> DataFrame:
    """All facts of each customer at once: accounts in credit as answered money models, orders as rules."""
    key = F.col("c_custkey")
    models = read(spark, sf, "customer").where("c_acctbal > 0").select(
        key.alias("repo"), F.col("c_mktsegment").alias("money_type"), F.when(key % 2 == 0, "Balance").alias("balance_func"), F.when(key % 3 == 0, "Move").alias("transfer_func"), F.when(key % 5 > 0, "key").otherwise("").alias("idempotency_key"), F.when(key % 4 == 0, "db_constraint").alias("uniqueness")
    )
    scenario = F.concat(F.lit("S"), F.col("o_orderkey") % 3)
    symbols = F.array_compact(F.array(F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))))
    rules = read(spark, sf, "orders").where("o_orderkey % 4 = 0").groupBy(F.col("o_custkey").alias("repo")).agg(symbols.alias("money_symbols"), F.collect_set(F.struct(scenario.alias("scenario"), F.when(scenario != "S0", "by rule").alias("why"))).alias("skip"))
    facts = predicates.facts_from(models, rules)
    return facts.withColumn("skipped", F.array_sort(F.transform(F.map_entries("skipped"), lambda e: F.concat_ws(" ", e["key"], e["value"]))))


@query("""
    select repo, case_id from (select c_nationkey as repo, c_custkey as case_id, row_number() over (partition by c_nationkey order by c_custkey) as r from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'O')) where r = 1""")
def next_case(spark: SparkSession, sf: str) -> DataFrame:
    """The first customer of each nation without an urgent open order."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_custkey").alias("case_id"), F.col("c_custkey").alias("ord"))
    runs = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'").select(F.col("o_custkey").alias("case_id")).join(c.select("repo", "case_id"), "case_id")
    return joins.pending(c, runs, first_only=True).select("repo", "case_id")


@query(r"""
    with l as (select doc_id, string_split(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)), chr(10))[1] as line from documents),
    c as (select *, list_aggregate(list_transform(range(1, least(len(line), 160) + 1), lambda i: case when strlen(line[:i]) <= 160 then i else 0 end), 'max') as fits from l)
    select doc_id, case when strlen(line) > 160 then line[:fits] else line end as line from c""")
def first_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of each document, cut at 160 bytes between characters."""
    return read(spark, sf, "documents").select("doc_id", text.first_line(F.coalesce("text", F.lit(""))).alias("line"))


@query("""
    with recursive o as (select o_orderpriority as repo, o_orderkey as k, round(o_totalprice * 100)::bigint as w, case o_orderpriority when '5-LOW' then 0 else 2000000000 end as budget, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as place from orders),
    g as (select repo, k, place, case when budget = 0 or w <= budget then w else 0 end as spent, budget = 0 or w <= budget as taken from o where place = 1
        union all select o.repo, o.k, o.place, g.spent + case when o.budget = 0 or g.spent + o.w <= o.budget then o.w else 0 end, o.budget = 0 or g.spent + o.w <= o.budget from g join o on o.repo = g.repo and o.place = g.place + 1)
    select g.repo, g.k as o_orderkey, g.place, g.taken, g.spent - case when g.taken then w else 0 end as spent from g join o using (repo, place)""")
def priority_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Which orders each priority takes within its budget by date: five large groups, each spread over tasks."""
    orders = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo"), "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("w"))
    budget = F.when(F.col("repo") == "5-LOW", 0).otherwise(2_000_000_000)
    return ranking.first_fit_split(orders, ["repo"], ["o_orderdate", "o_orderkey"], "w", budget).select("repo", "o_orderkey", "place", "taken", "spent")


@query("""
    with o as (select o_orderpriority as repo, o_orderkey, o_orderstatus, round(o_totalprice * 100)::bigint as w from orders),
    t as (select *, sum(w) over (partition by repo) - coalesce(sum(case when o_orderstatus <> 'P' then w else 0 end) over (partition by repo order by w desc, o_orderkey rows between unbounded preceding and 1 preceding), 0) as rest from o)
    select repo, o_orderkey, o_orderstatus <> 'P' and rest > 9000000000 as dropped from t""")
def priority_trims(spark: SparkSession, sf: str) -> DataFrame:
    """The dearest orders of each priority dropped until the rest is within 90 million, pending ones kept: five large groups, each spread over tasks."""
    orders = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo"), "o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("w"))
    return ranking.trimmed(orders, ["repo"], [F.desc("w"), F.col("o_orderkey")], "w", F.lit(9_000_000_000), F.col("o_orderstatus") != "P", split=True).select("repo", "o_orderkey", "dropped")
