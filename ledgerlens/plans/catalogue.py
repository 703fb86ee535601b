"""The registered queries: each operator of the rule engine over the given tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import cost, text, tristate
from ledgerlens.operators import joins, predicates, ranking, rollups, sets, state, validation
from ledgerlens.plans import flow_queries, rule_queries  # noqa: F401  register their queries too
from ledgerlens.plans.registry import QUERIES, SQL, query, read
from ledgerlens.sources import files


@query("""
    with f as (select c_nationkey as k, bool_or(c_acctbal < -900) as overdrawn, bool_or(c_mktsegment = 'BUILDING') as building from customer group by 1),
    s as (select s_nationkey as k, bool_or(s_acctbal > 9000) as rich, count(*) as n from supplier group by 1)
    select n_nationkey, n_name, case when n_regionkey = 0 then 'region is off' when not coalesce(overdrawn, false) then 'no overdrawn customer' when not coalesce(building, false) then 'no building customer'
        when coalesce(n, 0) < 2 then 'fewer than two suppliers' when not coalesce(rich, false) then 'no rich supplier' end as reason
    from nation left join f on f.k = n_nationkey left join s on s.k = n_nationkey""")
def eligibility_first_reason(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that each nation fails; existence is asked of customers and suppliers apart."""
    customers = predicates.exists_per(read(spark, sf, "customer").withColumnRenamed("c_nationkey", "k"), ["k"], overdrawn=F.col("c_acctbal") < -900, building=F.col("c_mktsegment") == "BUILDING")
    suppliers = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.bool_or(F.col("s_acctbal") > 9000).alias("rich"), F.count(F.lit(1)).alias("n"))
    profile = read(spark, sf, "nation").join(customers, F.col("n_nationkey") == customers.k, "left").drop("k").join(suppliers, F.col("n_nationkey") == suppliers.k, "left")
    no = F.lit(False)
    return profile.select("n_nationkey", "n_name", predicates.first_reason([
        (F.col("n_regionkey") == 0, "region is off"), (~F.coalesce("overdrawn", no), "no overdrawn customer"), (~F.coalesce("building", no), "no building customer"),
        (F.coalesce("n", F.lit(0)) < 2, "fewer than two suppliers"), (~F.coalesce("rich", no), "no rich supplier"),
    ]).alias("reason"))


RANK_SQL = "case when o_orderpriority = '1-URGENT' then 0 when o_orderpriority = '2-HIGH' then 1 when o_orderpriority = '3-MEDIUM' then 2 else 3 end"


@query(f"""
    select o_orderkey, o_custkey, {RANK_SQL} as severity_rank, row_number() over (partition by o_custkey order by case when o_orderstatus = 'F' then 1 else 0 end, {RANK_SQL}, o_orderkey) as place from orders""")
def severity_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders: open ones first, then by severity, then by key."""
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("info")
    cases = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("repo"), severity.alias("severity"), F.when(F.col("o_orderstatus") == "F", "done").alias("blocked"), F.col("o_orderkey").alias("ord"))
    return ranking.case_order(cases).select("o_orderkey", F.col("repo").alias("o_custkey"), predicates.severity_rank(F.col("severity")).alias("severity_rank"), "place")


@query("""
    select l_orderkey, case when bool_or(l_returnflag = 'R') then 'does not hold' when bool_or(l_returnflag = 'N') then 'unsettled' else 'holds' end as standing, count(*) as n_marks from lineitem group by 1""")
def tri_state_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The standing of each order over its lines: R contradicts, N is unknown, A supports."""
    verdict = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    marks = read(spark, sf, "lineitem").select("l_orderkey", tristate.mark(verdict, F.lit(True)).alias("mark"))
    return rollups.standings(marks, ["l_orderkey"])


@query("""
    with s as (select distinct user_id as machine, event_type as state from events), o as (select user_id, event_type, lead(event_type) over (partition by user_id order by event_id) as nxt from events)
    select a.machine, a.state as src, b.state as dst from s a join s b on a.machine = b.machine
    where not exists (select 1 from o where o.user_id = a.machine and o.event_type = a.state and o.nxt = b.state)""")
def illegal_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a user's event types, equal ones included, that never followed each other."""
    from pyspark.sql import Window

    e = read(spark, sf, "events").select(F.col("user_id").alias("machine"), F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("dst"))
    return joins.illegal(e.select("machine", F.col("src").alias("state")).distinct(), e.where("dst is not null").distinct())


@query("""
    with recursive o as (select o_custkey as c, o_orderkey as k, round(o_totalprice * 100)::bigint as w, row_number() over (partition by o_custkey order by o_orderkey) as i from orders),
    g as (select c, k, i, case when w <= 40000000 then w else 0 end as spent, w <= 40000000 as kept from o where i = 1
        union all select o.c, o.k, o.i, case when g.spent + o.w <= 40000000 then g.spent + o.w else g.spent end, g.spent + o.w <= 40000000 from g join o on o.c = g.c and o.i = g.i + 1)
    select c as o_custkey, k as o_orderkey from g where kept""")
def greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders, by key, that first-fit takes within 400,000: what overflows is passed over."""
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("w"))
    return ranking.fits(orders, ["o_custkey"], ["o_orderkey"], "o_orderkey", "w", F.lit(40000000))


@query("""
    with o as (select o_custkey, o_orderkey, round(o_totalprice * 100)::bigint as w from orders),
    t as (select *, sum(w) over (partition by o_custkey) - coalesce(sum(w) over (partition by o_custkey order by w desc, o_orderkey rows between unbounded preceding and 1 preceding), 0) as rest from o)
    select o_custkey, o_orderkey, rest > 40000000 as dropped from t""")
def prefix_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders, dropped from the dearest until the rest is within 400,000."""
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("w"))
    return ranking.trimmed(orders, ["o_custkey"], [F.desc("w"), F.col("o_orderkey")], "w", F.lit(40000000)).select("o_custkey", "o_orderkey", "dropped")


@query("""
    with l as (select l_partkey, l_orderkey, l_linenumber, l_suppkey, row_number() over (partition by l_partkey order by s_nationkey, l_orderkey, l_linenumber, l_suppkey) as rn from lineitem join supplier on s_suppkey = l_suppkey where s_acctbal > 0)
    select l_partkey, l_orderkey, l_linenumber, l_suppkey from l where rn = 1""")
def seam_scope_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as call sites of their parts: of those whose supplier is reached (above zero) the first of each part, by nation, then by place."""
    place = F.struct("l_orderkey", "l_linenumber", "l_suppkey")
    sites = read(spark, sf, "lineitem").select(F.lit(0).alias("repo"), F.col("l_suppkey").alias("in_id"), F.col("l_partkey").alias("target"), place.alias("ord"))
    reached = read(spark, sf, "supplier").where("s_acctbal > 0").select(F.lit(0).alias("repo"), F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("entry_ord"))
    return joins.scoped(sites, reached).select(F.col("target").alias("l_partkey"), "ord.l_orderkey", "ord.l_linenumber", "ord.l_suppkey")


@query("""
    with o as (select o_custkey as k, count(*) as n, bool_or(o_orderpriority = '1-URGENT') as urgent from orders group by 1),
    r as (select c_custkey, unnest([case when c_acctbal > 5000 then {'t': 'ledger', 'w': 3} end, case when c_mktsegment in ('BUILDING', 'MACHINERY') then {'t': 'ledger', 'w': 2} end,
        case when c_acctbal < 0 then {'t': 'wallet', 'w': 3} end, case when coalesce(n, 0) > 10 then {'t': 'wallet', 'w': 2} end, case when coalesce(urgent, false) then {'t': 'wallet', 'w': 1} end]) as r from customer left join o on k = c_custkey),
    g as (select c_custkey, coalesce(sum(r.w) filter (where r.t = 'ledger'), 0) as a, coalesce(sum(r.w) filter (where r.t = 'wallet'), 0) as b from r group by 1)
    select c_custkey, a::bigint as ledger, b::bigint as wallet, case when a = 0 and b = 0 then 'stateless' when a > b then 'ledger' else 'wallet' end as kind, (a < b + 2 and b < a + 2) and (a > 0 or b > 0) as unsure from g""")
def additive_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Customers scored by weighted rules for two kinds, with a margin of two."""
    orders = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    customers = read(spark, sf, "customer")
    profile = customers.join(orders, F.col("c_custkey") == F.col("k"), "left")
    rules = [
        ("ledger", 3, "rich", F.col("c_acctbal") > 5000), ("ledger", 2, "segment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY")),
        ("wallet", 3, "overdrawn", F.col("c_acctbal") < 0), ("wallet", 2, "busy", F.coalesce("n", F.lit(0)) > 10), ("wallet", 1, "urgent", F.coalesce("urgent", F.lit(False))),
    ]
    scored = rollups.scores(profile, ["c_custkey"], rules).groupBy("c_custkey").pivot("type", ["ledger", "wallet"]).agg(F.first("score"))
    every = customers.select("c_custkey").join(scored, "c_custkey", "left").na.fill(0, ["ledger", "wallet"])
    kind, unsure = rollups.margin(F.col("ledger"), F.col("wallet"), ("ledger", "wallet", "stateless"))
    return every.select("c_custkey", "ledger", "wallet", kind.alias("kind"), unsure.alias("unsure"))


@query("""
    with s as (select p_partkey as question, 'brand ' || p_brand as reason, 0 as src, p_partkey as pos from part where p_size > 20 union all select p_partkey, 'type ' || split_part(p_type, ' ', 1), 1, p_partkey from part where p_retailprice > 1000
        union all select p_partkey, 'size ' || p_size, 2, p_partkey from part where p_size < 30)
    select question, min(src * 1000000000 + pos) as ord, list_sort(list_distinct(list(reason))) as reasons from s where question not in (select l_partkey from lineitem where l_quantity > 48) group by 1""")
def needed_union_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Parts named by three sources and not yet sold in bulk, with their first place and reasons."""
    part = read(spark, sf, "part")
    source = lambda k, cond, reason: part.where(cond).select(F.col("p_partkey").alias("question"), reason.alias("reason"), (F.lit(k * 1000000000).cast("long") + F.col("p_partkey")).alias("ord"))
    every = source(0, "p_size > 20", F.concat(F.lit("brand "), F.col("p_brand"))).unionByName(source(1, "p_retailprice > 1000", F.concat(F.lit("type "), F.substring_index("p_type", " ", 1)))).unionByName(source(2, "p_size < 30", F.concat(F.lit("size "), F.col("p_size"))))
    return joins.needed(every, read(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("question")))


@query("""
    with c as (select *, l_returnflag <> 'R' as on_, l_returnflag || l_linestatus || (l_linenumber % 4) as scenario, ['tx', 'balance', 'machine', 'key', 'injectable', 'money', 'transfer'][l_linenumber] as need from lineitem)
    select l_suppkey % 10 * 100 + l_quantity::int as repo, count(*) filter (where on_) as runnable, count(*) filter (where not on_) as blocked, coalesce(list_sort(list_distinct(list(scenario) filter (where on_))), []) as scenarios,
        bool_or(on_ and need in ('money', 'transfer', 'balance', 'key') and l_shipdate < '1992-06-01') as money, bool_or(on_ and need = 'key' and l_shipdate < '1992-06-01') as main_entity from c group by 1""")
def demand(spark: SparkSession, sf: str) -> DataFrame:
    """Per group of suppliers and quantity: kept and returned lines, the distinct kinds of those kept, and what their needs ask for."""
    kind = F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 4).cast("string"))
    need = F.when(F.col("l_shipdate") < "1992-06-01", F.array(F.element_at(F.array(*[F.lit(x) for x in ("tx", "balance", "machine", "key", "injectable", "money", "transfer")]), F.col("l_linenumber").cast("int"))))
    repo = F.col("l_suppkey") % 10 * 100 + F.col("l_quantity").cast("int")
    cases = read(spark, sf, "lineitem").select(repo.alias("repo"), (F.col("l_returnflag") != "R").alias("runnable"), kind.alias("scenario"), kind.alias("technique"), need.alias("requires"))
    return rollups.demand(cases).select("repo", "runnable", "blocked", "scenarios", "money", "main_entity")


@query("""
    select scenario, p_brand, list_sort(list_distinct(list(cast(p_size as varchar)))) as sizes from (select p_brand, split_part(p_type, ' ', 1) as scenario, p_size from part) group by 1, 2""")
def demanded_by(spark: SparkSession, sf: str) -> DataFrame:
    """For each first word of a type and brand, the sizes that want it."""
    part = read(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.lit(True).alias("runnable"), F.col("p_size").cast("string").alias("scenario"), F.array(F.substring_index("p_type", " ", 1)).alias("wants"))
    return rollups.demanded_by(part, "wants", "want").select(F.col("want").alias("scenario"), F.col("repo").alias("p_brand"), F.col("scenarios").alias("sizes"))


@query("""
    with sold as (select distinct p_brand, p_type as t from part join lineitem on l_partkey = p_partkey where l_quantity > 30), listed as (select distinct p_brand, p_type as t from part where p_size < 25)
    select p_brand, coalesce(list_sort(list(t) filter (where s and not l)), []) as only_left, coalesce(list_sort(list(t) filter (where l and not s)), []) as only_right, count(*) filter (where s and l) as shared
    from (select p_brand, t, max(s) as s, max(l) as l from (select p_brand, t, true as s, false as l from sold union all select p_brand, t, false, true from listed) group by 1, 2) group by 1 having count(*) filter (where s and l) > 0""")
def set_diff_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Per brand: types sold in quantity but not listed small, and the other way round, where they share any."""
    part = read(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_type").alias("t"), "p_size")
    sold = part.join(read(spark, sf, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    return joins.set_differences(sold, part.where("p_size < 25"), ["p_brand"], "t")


@query("""
    with c as (select n_regionkey, n_name, count(*) as n, round(sum(c_acctbal) * 100)::bigint as w from customer join nation on n_nationkey = c_nationkey group by 1, 2 having count(*) filter (where c_acctbal > 0) > 0)
    select * from (select n_regionkey, n_name, n, row_number() over (partition by n_regionkey order by n desc, n_name) as rank from c) where rank <= 4""")
def top_k_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The four nations of each region with the most customers, ties by name."""
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("good")).where("good > 0")
    return ranking.top_per_group(c.drop("good"), ["n_regionkey"], [F.desc("n"), F.col("n_name")], 4).withColumn("rank", F.col("rank").cast("long"))


@query("""
    select o_custkey, o_orderkey from (select *, o_orderpriority = '1-URGENT' as d, row_number() over (partition by o_custkey, o_orderpriority = '1-URGENT' order by o_orderkey) as r from orders) where d or r <= 3""")
def per_group_cap(spark: SparkSession, sf: str) -> DataFrame:
    """All urgent orders of each customer, and the first three of the others."""
    ids = read(spark, sf, "orders").select(F.lit(0).alias("repo"), F.col("o_custkey").alias("owner"), (F.col("o_orderpriority") == "1-URGENT").alias("declarative"), F.col("o_orderkey").alias("ord"))
    return ranking.trimmed_ids(ids).select(F.col("owner").alias("o_custkey"), F.col("ord").alias("o_orderkey"))


@query("""
    select s_nationkey, s_suppkey, score from (select *, cast(floor(s_acctbal / 2000) as bigint) as score, row_number() over (partition by s_nationkey order by floor(s_acctbal / 2000) desc, s_suppkey) as r from supplier) where r = 1""")
def argmax_first(spark: SparkSession, sf: str) -> DataFrame:
    """The supplier of each nation with the greatest score; the first on ties."""
    return ranking.best(read(spark, sf, "supplier"), ["s_nationkey"], F.floor(F.col("s_acctbal") / 2000), "s_suppkey", "s_suppkey")


@query("""
    select c, p, items, row_number() over (partition by c order by ord) as batch from (select o_custkey as c, o_orderpriority as p, min(o_orderkey) as ord, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as items from orders group by 1, 2)""")
def batching(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders batched by priority, batches in the order in which they are first seen."""
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), "o_orderkey", F.col("o_orderkey").alias("ord"))
    return rollups.batches(orders, ["c"], "p", "ord", "o_orderkey").select("c", "p", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.col("batch").cast("long").alias("batch"))


@query("""
    with d as (select doc_id, strlen(text) // 4 as input, 21 * greatest(doc_id % 4, 1) as output from documents)
    select doc_id, input, output, input + 5 * output as weighted, case when input < 1000 then cast(input as varchar) else cast(cast(round_even(cast(input as decimal(20,3)) / 1000, 1) as decimal(20,1)) as varchar) || 'k' end as shown from d""")
def cost_model(spark: SparkSession, sf: str) -> DataFrame:
    """Token costs of documents as prompts: bytes by four, output five times as dear."""
    d = read(spark, sf, "documents").select("doc_id", cost.input_tokens(F.col("text")).alias("input"), cost.output_tokens(F.lit("externalEffect"), F.lit("open"), F.col("doc_id") % 4).alias("output"))
    return d.select("doc_id", "input", "output", cost.weighted(F.col("input"), F.col("output")).alias("weighted"), cost.short(F.col("input")).alias("shown"))


@query("""
    select o_custkey as repo, coalesce(sum(w) filter (where c), 0)::bigint as total, coalesce(sum(w) filter (where not c), 0)::bigint as avoided,
        cast(case when sum(w) = 0 then 0 else round_even(100 * coalesce(sum(w) filter (where not c), 0)::double / sum(w)::double, 0) end as bigint) as saved_percent
    from (select o_custkey, o_orderstatus <> 'F' as c, o_orderkey % 97 + 5 * (o_orderkey % 31) as w from orders) group by 1""")
def plan_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: the cost of the open orders, of the others, and the share saved."""
    choices = read(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), (F.col("o_orderstatus") != "F").alias("chosen"), (F.col("o_orderkey") % 97).alias("input"), (F.col("o_orderkey") % 31).alias("output"))
    return rollups.plan_totals(choices.select("*", F.col("input").alias("asked_input"), F.col("output").alias("asked_output")), ["repo"])


TOPICS = {"law": ["license", "copyright", "version"], "access": ["password", "token", "secret"], "small words": ["the", "with", "que", "und"]}


@query("""
    with v as (select unnest([{'t': 'law', 'w': ['license', 'copyright', 'version']}, {'t': 'access', 'w': ['password', 'token', 'secret']}, {'t': 'small words', 'w': ['the', 'with', 'que', 'und']}]) as v),
    h as (select doc_id, v.t as topic, list_sum(list_transform(v.w, lambda w: (strlen(lower(text)) - strlen(replace(lower(text), w, ''))) // strlen(w))) as n from documents cross join v)
    select doc_id, cast(sum(n + case when n >= 5 then 5 else 0 end) as bigint) as score, list(topic order by topic) as topics from h where n > 0 group by 1""")
def doc_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Documents scored by the words of topics, five more for a topic that is hit five times or more."""
    low = read(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    hits = F.array(*[F.struct(F.lit(t).alias("topic"), sum((text.occurrences(F.col("low"), F.lit(w)) for w in words), F.lit(0)).alias("n")) for t, words in TOPICS.items()])
    # The search for any word comes first: a filter on the hits would count them all twice.
    some = low.where(text.any_within(F.col("low"), [w for words in TOPICS.values() for w in words]))
    found = some.select("doc_id", F.filter(hits, lambda h: h["n"] > 0).alias("h"))
    score = F.aggregate("h", F.lit(0).cast("long"), lambda a, h: a + h["n"] + F.when(h["n"] >= 5, 5).otherwise(0))
    return found.select("doc_id", score.alias("score"), F.array_sort(F.transform("h", lambda h: h["topic"])).alias("topics"))


@query(r"""
    select p_partkey, rtrim(ltrim(right(rtrim(ltrim(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9]+', '-', 'g'), '-'), '-'), 20), '-'), '-') as slug,
        ltrim(lower(regexp_replace(p_brand || 'TraceID', '([A-Z])', '_\1', 'g')), '_') as snake,
        'Test' || list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') as test_name,
        trim(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g'), '_') as diagram_id, replace(replace(replace('<' || p_name || '>', '"', '&quot;'), '<', '&lt;'), '>', '&gt;') as escaped,
        list_filter([lower(split_part(p_type, ' ', -1)), lower(split_part(p_type, ' ', -1)) || 's', case when lower(split_part(p_type, ' ', -1)) like '%y' then left(lower(split_part(p_type, ' ', -1)), length(split_part(p_type, ' ', -1)) - 1) || 'ies' end,
            case when regexp_matches(lower(split_part(p_type, ' ', -1)), '(s|x|ch)$') then lower(split_part(p_type, ' ', -1)) || 'es' end], lambda x: x is not null) as table_names,
        case when instr(p_name, ' ') > 1 and strlen(p_name) > 12 then left(p_name, 9) || '...' when strlen(p_name) > 12 then left(p_name, 9) || '...' else p_name end as cut
    from part""")
def scalar_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The string functions over part names."""
    part = read(spark, sf, "part")
    return part.select(
        "p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_type"), 20).alias("slug"), text.snake(F.concat("p_brand", F.lit("TraceID"))).alias("snake"),
        text.test_name(F.replace(F.col("p_type"), F.lit(" "), F.lit("-"))).alias("test_name"), text.diagram_id(F.col("p_brand")).alias("diagram_id"), text.html_escape(F.concat(F.lit("<"), F.col("p_name"), F.lit(">"))).alias("escaped"),
        text.table_names(F.lower(F.substring_index("p_type", " ", -1))).alias("table_names"), text.ellipsis(F.col("p_name"), 12).alias("cut"),
    )


@query(r"""
    select page_id, trim(regexp_extract(replace(replace(html, '<h1>', chr(10) || '## '), '</h1>', chr(10)), '(?m)^#[# ]*(.*)$', 1)) as heading, string_split(trim(html, ' ' || chr(9) || chr(13) || chr(10)), chr(10))[1] as head,
        trim(regexp_replace(split_part(url, '/', -1), '[^A-Za-z0-9]+', '_', 'g'), '_') as last from pages""")
def page_headings(spark: SparkSession, sf: str) -> DataFrame:
    """The first heading and line of pages."""
    pages = read(spark, sf, "pages")
    marked = F.replace(F.replace(F.col("html"), F.lit("<h1>"), F.lit("\n## ")), F.lit("</h1>"), F.lit("\n"))
    return pages.select("page_id", text.first_heading(marked).alias("heading"), text.first_line(F.col("html"), 1 << 30).alias("head"), text.diagram_id(text.short_type(F.col("url"))).alias("last"))


JSON_OF = "case event_id % 6 when 0 then 'true' when 1 then 'false' when 2 then '\"true\"' when 3 then '1' when 4 then 'null' else '\"' || event_type || '\"' end"


@query(f"""
    with j as (select event_id, {JSON_OF} as a, {JSON_OF.replace('event_id', '(event_id // 6)')} as b from events)
    select event_id, a = 'true' as is_true, a = 'false' as is_false, not (a = 'false') and not (b = 'true') as escapes from j""")
def literal_true(spark: SparkSession, sf: str) -> DataFrame:
    """Literal true and false among JSON values; what may escape a rollback."""
    a, b = F.expr(JSON_OF), F.expr(JSON_OF.replace("event_id", "(event_id div 6)"))
    return read(spark, sf, "events").select("event_id", tristate.is_true(a).alias("is_true"), tristate.is_false(a).alias("is_false"), tristate.escapes_rollback(a, b).alias("escapes"))


@query("""
    select conv_id, turn, list_filter([case when coalesce(role, '') not in ('user', 'assistant') then 'unknown representation' end, case when length(text) % 4 not in (0, 1, 2) then 'unknown uniqueness' end,
        case when trim(role) <> '' and length(text) < 40 then 'a type without proof' end, case when lower(trim(role)) in ('todo', 'tbd', 'n/a', 'unknown', '...') then 'a placeholder for a name' end], lambda x: x is not null) as problems from conversations""")
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns checked as money models: the array of what is wrong."""
    shown = F.element_at(F.array(*[F.lit(x) for x in ("none", "unknown", "db_constraint", "?")]), F.length("text") % 4 + 1)
    role = F.when(F.coalesce("role", F.lit("")).isin("user", "assistant"), "decimal").otherwise("other")
    return read(spark, sf, "conversations").select("conv_id", "turn", validation.money_model(role, shown, F.col("role"), F.when(F.length("text") >= 40, F.col("text"))).alias("problems"))


@query("""
    select d.doc_id, case when l.doc_id is null then 'missing' when l.quality = 1 then 'answered' else 'invalid' end as status from documents d left join labels l on l.doc_id = d.doc_id""")
def answer_join(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels: missing, invalid or answered."""
    return joins.answer_status(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), "doc_id", F.col("quality") == 1).select("doc_id", "status")


@query("""
    with m as (select p_brand as repo, list_sort(list_distinct(list(p_name))) as a from part p where not exists (select 1 from part q join lineitem on l_partkey = q.p_partkey where q.p_brand = p.p_brand and q.p_name = p.p_name and l_quantity > 48) group by 1)
    select repo, a[1:4] as missing, greatest(len(a) - 4, 0) as more from m""")
def round_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Per brand the names never sold in bulk: the first four, and how many more."""
    part = read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("repo"), "p_name")
    sold = part.join(read(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("repo", "p_name").distinct()
    return joins.gate(part.select("repo", "p_name").distinct(), sold, ["repo"], "p_name")


@query("""
    with f as (select l_suppkey as repo, l_returnflag || l_linestatus as id, l_orderkey * 10 + l_linenumber as ord, l_shipdate, cast(l_partkey as varchar) as place from lineitem),
    s as (select *, row_number() over (partition by repo, id order by ord, place) as r from f)
    select repo, id, count(*) as n, min(place) filter (where r = 1) as title, list(place order by ord, place) filter (where r <= 6) as places, row_number() over (partition by repo order by count(*) desc, id) as place from s group by 1, 2""")
def findings_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per supplier and kind of line: the count, the first part, and at most six parts."""
    part = F.col("l_partkey").cast("string")
    f = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("repo"), F.concat("l_returnflag", "l_linestatus").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), part.alias("title"), part.alias("place"), F.lit("high").alias("severity"))
    return rollups.by_count(f).drop("severity").withColumn("place", F.col("place").cast("long"))


@query("""
    select s_nationkey as repo, count(*) filter (where s_acctbal > 0) as injectable, count(*) filter (where not s_acctbal > 0) as concrete from supplier group by 1""")
def seam_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of each nation above and not above zero."""
    return rollups.seam_summary(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("repo"), (F.col("s_acctbal") > 0).alias("injectable")))


@query("""
    with t as (select o_custkey as k from orders where o_orderpriority = '1-URGENT'), all_c as (select c_nationkey, min(c_custkey) as first from customer group by 1)
    select c_nationkey, c_custkey from customer where c_custkey in (select k from t) union select c_nationkey, first from all_c where c_nationkey not in (select c_nationkey from customer where c_custkey in (select k from t))""")
def entries_under_test(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with an urgent order; in a nation without any, its first customer."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_custkey").alias("ord"))
    reached = c.select("repo", F.col("ord").alias("entry_ord"), F.col("ord").alias("node"))
    seams = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("ord")).join(c, "ord").select("repo", F.col("ord").alias("in_id"))
    return joins.under_test(c, reached, seams).select(F.col("repo").alias("c_nationkey"), F.col("ord").alias("c_custkey"))


@query("""
    with p as (select case when p_size % 3 = 0 then split_part(p_name, ' ', 2) || 's' when p_size % 3 = 1 then lower(p_type) || p_size else p_name end as n, lower(p_brand) as col, p_size from part),
    w as (select unnest(['widget', 'widgets', 'economy1', 'economy1s']) as n union select n from p where p_size > 48)
    select n as table, n in (select n from w) or bool_or(col in (select 'brand#' || s_nationkey from supplier where s_acctbal > 9900)) as relevant from p group by n""")
def relevant_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as tables with their brands as columns: constrained (large parts), named like an owner (pkg.Widget, Economy1) or with a column named like a key."""
    p = F.col("p_size") % 3
    name = F.when(p == 0, F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("s"))).when(p == 1, F.concat(F.lower("p_type"), "p_size")).otherwise(F.col("p_name"))
    part = read(spark, sf, "part").select(F.lit(0).alias("repo"), name.alias("table"), "p_brand", "p_size")
    tables = part.groupBy("repo", "table").agg(F.collect_set("p_brand").alias("columns"))
    owners = spark.createDataFrame([(0, "pkg.Widget"), (0, "Economy1")], "repo int, owner string")
    keys = read(spark, sf, "supplier").where("s_acctbal > 9900").select(F.lit(0).alias("repo"), F.concat(F.lit("Brand#"), "s_nationkey").alias("name"))
    return joins.relevant_tables(tables, part.where("p_size > 48").select("repo", "table"), owners, keys).select("table", "relevant")


@query("""
    select n_name, count(*) as n from (select n_name, unnest(rs) as r from (select n_name, list_distinct(list(c_mktsegment)) as rs from nation join customer on c_nationkey = n_nationkey group by 1)) group by 1""")
def reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many reasons (segments) each nation has."""
    needs = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("repo")).agg(F.collect_set("c_mktsegment").alias("reasons"))
    return rollups.reason_histogram(needs).groupBy(F.col("repo").alias("n_name")).agg(F.sum("n").alias("n"))


@query("""
    select c_nationkey as repo, list_sort(list_distinct(list(c_mktsegment))) as have, list_sort(list_filter(['AUTOMOBILE', 'BUILDING', 'CASH', 'FURNITURE'], lambda x: not list_contains(list(c_mktsegment), x))) as missing from customer group by 1""")
def missing_overlays(spark: SparkSession, sf: str) -> DataFrame:
    """Expected segments that a nation's customers lack."""
    have = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("repo")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("have"))
    return have.withColumn("missing", sets.missing(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "CASH", "FURNITURE")]), F.col("have")))


@query("""
    select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by case when o_orderdate >= timestamp '1995-01-01' then 1 else 0 end desc, o_orderkey desc) as r from orders) where r = 1""")
def run_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The last order of each customer, newer ones replacing those from before 1995."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")).alias("late"))
    return state.upserted(o.where("not late").drop("late"), o.where("late").drop("late"), ["o_custkey"], "o_orderkey")


@query("""
    select c_custkey as case_id, c_nationkey as repo from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'O')""")
def pending_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an urgent open order."""
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_custkey").alias("case_id"), F.col("c_custkey").alias("ord"))
    runs = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'").select(F.col("o_custkey").alias("case_id")).join(c.select("repo", "case_id"), "case_id")
    return joins.pending(c, runs).select("case_id", "repo")


@query("""
    select c_custkey, list_filter([case when c_acctbal < 0 then 'overdrawn' end, case when c_mktsegment = 'BUILDING' then 'building' end, case when c_nationkey < 5 then 'nation ' || c_nationkey end], lambda x: x is not null) as tags,
        concat_ws(', ', case when c_custkey % 2 = 0 then 'primary key' end, case when c_custkey % 3 = 0 and c_custkey % 5 <> 0 then 'not null, no default' when c_custkey % 3 = 0 then 'not null, default ' || c_nationkey when c_custkey % 5 = 0 then 'default ' || c_nationkey end) as note,
        case when lower(c_mktsegment) like '%float%' then 'float' when lower(c_mktsegment) like '%decimal%' or lower(c_mktsegment) like '%big.rat%' then 'decimal' when lower(c_mktsegment) like '%in%' then 'minor_units_int' else 'unknown' end as form
    from (select * from customer)""")
def fact_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and notes of customers."""
    k = F.col("c_custkey")
    form = predicates.representation(F.regexp_replace(F.lower("c_mktsegment"), "in", "int"))
    return read(spark, sf, "customer").select(
        k, predicates.labels([(F.col("c_acctbal") < 0, "overdrawn"), (F.col("c_mktsegment") == "BUILDING", "building"), (F.col("c_nationkey") < 5, F.concat(F.lit("nation "), F.col("c_nationkey")))]).alias("tags"),
        predicates.column_note(k % 2 == 0, k % 3 == 0, F.when(k % 5 == 0, F.col("c_nationkey").cast("string"))).alias("note"), form.alias("form"),
    )


@query("""
    select o_orderkey, case when o_orderkey % 4 = 0 then 'round 1' when o_orderstatus = 'F' then 'blocked' when o_orderkey % 3 = 0 then 'round 2' else 'done' end as status from orders""")
def round_status(spark: SparkSession, sf: str) -> DataFrame:
    """The round of each order."""
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k, state.round_status((k % 4 == 0).cast("int"), F.when(F.col("o_orderstatus") == "F", "blocked"), (k % 3 == 0).cast("int")).alias("status"))


@query("""
    with r as (select s_nationkey as k, bool_or(s_acctbal > 9500) as any_injectable from supplier group by 1)
    select p_partkey, p_size % 25 as k, case when coalesce(any_injectable, false) or split_part(p_type, ' ', 1) <> 'STANDARD' then p_type else p_brand end as technique from part left join r on k = p_size % 25""")
def first_allowed_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The first of a part's choices that its nation's suppliers do not bar."""
    rich = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.bool_or(F.col("s_acctbal") > 9500).alias("any_injectable"))
    part = read(spark, sf, "part").withColumn("k", F.col("p_size").cast("long") % 25).join(rich, "k", "left")
    barred = F.when(F.coalesce("any_injectable", F.lit(False)) | (F.substring_index("p_type", " ", 1) != "STANDARD"), F.array().cast("array<string>")).otherwise(F.array("p_type"))
    return part.select("p_partkey", "k", predicates.first_allowed(F.array("p_type", "p_brand"), barred).alias("technique"))


@query("""
    with a as (select c_custkey as repo, case when c_acctbal < 0 then null else c_mktsegment end as money_type from customer), r as (select o_custkey as repo, min(o_orderstatus) as money_type from orders where o_orderpriority = '1-URGENT' group by 1)
    select coalesce(a.repo, r.repo) as repo, coalesce(nullif(r.money_type, ''), a.money_type) as money_type, coalesce(a.money_type, '') <> '' or coalesce(r.money_type, '') <> '' as known from a full join r on a.repo = r.repo""")
def bound_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What orders say of a customer, else what is on file; known once either speaks."""
    none = [F.lit(None).cast("string").alias(c) for c in ("balance_func", "transfer_func", "idempotency_key", "uniqueness")]
    answers = read(spark, sf, "customer").select(F.col("c_custkey").alias("repo"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("money_type"), *none)
    rules = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("repo")).agg(F.min("o_orderstatus").alias("money_type")).select("repo", "money_type", *none)
    return predicates.bound_facts(answers, rules).select("repo", "money_type", "known")


@query("""
    with o as (select o_custkey, list_sort(list_distinct(list(cast(o_orderkey as varchar)) filter (where o_orderstatus = 'O'))) as ids, count(*) filter (where o_orderstatus = 'O' and o_orderpriority = '1-URGENT') as d, sum(o_orderkey % 7) as w from orders group by 1),
    e as (select c_nationkey, c_custkey, coalesce(ids, []) as ids, w, row_number() over (partition by c_nationkey order by w desc, len(coalesce(ids, [])) desc, cast(c_custkey as varchar)) as rank from customer join o on o_custkey = c_custkey where d > 0)
    select c_nationkey, c_custkey, ids, cast(w as bigint) as weight, rank from e where rank <= 4""")
def main_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The four weightiest customers of each nation that have an urgent open order, with their open orders."""
    o = read(spark, sf, "orders")
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_custkey").cast("string").alias("owner"))
    cand = o.select(F.col("o_custkey").cast("string").alias("owner"), F.when(F.col("o_orderstatus") == "O", "idempotency").otherwise("money").alias("role"), F.col("o_orderkey").cast("string").alias("name"), (F.col("o_orderpriority") == "1-URGENT").alias("declarative"), (F.col("o_orderkey") % 7).alias("weight")).join(c, "owner")
    return joins.entities(cand, c).select(F.col("repo").alias("c_nationkey"), F.col("owner").cast("long").alias("c_custkey"), "ids", "weight", F.col("rank").cast("long").alias("rank"))


@query("""
    select o_orderkey from orders o where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 40 and l_returnflag = 'A')""")
def chosen_asks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of which a line was chosen."""
    asks = read(spark, sf, "orders").select(F.lit(0).alias("repo"), F.lit("A").alias("kind"), F.col("o_orderkey").alias("subject"))
    choices = read(spark, sf, "lineitem").select(F.lit(0).alias("repo"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("subject"), (F.col("l_quantity") > 40).alias("chosen"))
    return joins.chosen_asks(asks, choices).select(F.col("subject").alias("o_orderkey"))


@query("""
    with every as (select p_partkey as id, p_name as text, 0 as o from part union all select p_partkey, p_brand, 1 from part where p_size > 25 union all select p_partkey, p_type, 2 from part where p_size > 40)
    select id, text from (select *, row_number() over (partition by id order by o desc) as r from every) where r = 1""")
def question_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The text of each part over three registries, the last that has it."""
    part = read(spark, sf, "part")
    of = lambda c, cond: part.where(cond).select(F.col("p_partkey").alias("id"), F.col(c).alias("text"))
    return joins.lookup_questions([of("p_name", "true"), of("p_brand", "p_size > 25"), of("p_type", "p_size > 40")])


@query("""
    with s as (select l_suppkey as k, list(cast(l_partkey as varchar) order by l_orderkey, l_partkey) as parts from lineitem group by 1), w as (select s_nationkey as n, list(s_name order by s_suppkey, s_name) as names from supplier group by 1)
    select s_suppkey, array_to_string(coalesce(parts, []), ',') as parts, array_to_string(names, ',') as names from supplier left join s on k = s_suppkey left join w on n = s_suppkey""")
def step_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with their lines and with the suppliers of the nation of their number, in order."""
    nodes = read(spark, sf, "supplier").select(F.lit(0).alias("repo"), F.col("s_suppkey").alias("id"))
    seams = read(spark, sf, "lineitem").select(F.lit(0).alias("repo"), F.col("l_suppkey").alias("in_id"), F.col("l_orderkey").alias("line"), F.col("l_partkey").cast("string").alias("target"))
    writes = read(spark, sf, "supplier").select(F.lit(0).alias("repo"), F.col("s_nationkey").cast("long").alias("in_id"), F.col("s_suppkey").alias("line"), F.col("s_name").alias("to"))
    out = joins.steps(nodes, seams.withColumn("target", F.col("target")), writes)
    text_of = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), ","), F.lit(""))
    ordered = F.transform(F.array_sort(F.transform("seams", lambda x: F.struct(x["line"].alias("line"), x["target"].cast("long").alias("n")))), lambda x: x["n"].cast("string"))
    return out.select(F.col("id").alias("s_suppkey"), F.coalesce(F.array_join(ordered, ","), F.lit("")).alias("parts"), F.when(F.col("writes").isNotNull(), text_of("writes", "to")).alias("names"))


@query("""
    select o_custkey as repo, cast((sum(strlen(o_orderpriority || o_orderstatus)) + 400) // 4 as bigint) as input, case when count(*) > 1 then 100 * (count(*) - 1) else 0 end as saved from orders group by 1""")
def pack_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each customer's orders as prompts with one preamble of 400 bytes, and those saved."""
    asks = read(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.concat("o_orderpriority", "o_orderstatus").alias("prompt"), F.lit("x" * 400).alias("preamble"))
    return rollups.pack_estimate(asks, F.col("preamble"))


@query("""
    select o_custkey as repo, o_orderpriority as kind, count(*) as n, cast(sum(o_orderkey % 97 + 5 * (o_orderkey % 31)) as bigint) as cost, arg_min(o_orderstatus, o_orderkey) as why from orders where o_orderstatus <> 'F' group by 1, 2""")
def explained_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's chosen orders by priority: count, cost, and the first one's status."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") != "F").alias("chosen"), F.col("o_orderstatus").alias("why"), F.lit("open").alias("method"), (F.col("o_orderkey") % 97).alias("input"), (F.col("o_orderkey") % 31).alias("output"), F.lit(0).alias("trimmable"))
    return rollups.explained(o)["chosen"].select("repo", "kind", "n", "cost", "why")


@query("""
    with e as (select distinct user_id, event_type from events), f as (select unnest([{'f': 'buys', 'q': 'purchase', 'h': true}, {'f': 'buys', 'q': 'click', 'h': true}, {'f': 'quiet', 'q': 'error', 'h': false}, {'f': 'quiet', 'q': 'logout', 'h': true}]) as x),
    a as (select user_id, event_type as q, case when n % 3 = 0 then null else n % 2 = 0 end as v from (select user_id, event_type, count(*) as n from events group by 1, 2)),
    m as (select a.user_id as repo, x.f as feature, case when v is null then 'u' when v = x.h then 's' else 'c' end as m from a join f on x.q = a.q)
    select repo, feature, case when bool_or(m = 'c') then 'does not hold' when bool_or(m = 'u') then 'unsettled' else 'holds' end as standing, count(*) as n_marks from m group by 1, 2""")
def feature_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Two features over each user's event counts as verdicts: multiples of three unknown, else whether even."""
    evidence = spark.createDataFrame([(0, 0, "buys", "purchase", True), (0, 0, "buys", "click", True), (0, 1, "quiet", "error", False), (0, 1, "quiet", "logout", True)], "area_ord int, ord int, feature string, question string, holds_when boolean")
    n = F.count(F.lit(1))
    answers = read(spark, sf, "events").groupBy(F.col("user_id").alias("repo"), F.col("event_type").alias("question")).agg(F.when(n % 3 != 0, n % 2 == 0).alias("verdict"))
    return rollups.roll_up(F.broadcast(evidence), answers).select("repo", "feature", "standing", "n_marks")


@query("""
    with s as (select c_nationkey as repo, list_distinct(list(c_mktsegment)) as states, list_distinct(list(c_mktsegment) filter (where c_acctbal > 0)) as answered from customer group by 1)
    select repo, list_filter([case when len(list_filter(states, lambda x: not list_contains(answered, x))) > 0 then 'a state is not covered' end, case when list_contains(answered, 'BUILDING') then 'an undeclared target' end, case when list_contains(answered, 'MACHINERY') then 'a final state with exits' end], lambda x: x is not null) as problems from s""")
def transition_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Nations whose segments are not all covered by solvent customers; BUILDING moves out of the nation, MACHINERY is final."""
    s = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("repo")).agg(F.collect_set("c_mktsegment").alias("states"), F.collect_set(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).alias("answered"))
    moves = F.map_from_arrays("answered", F.transform("answered", lambda a: F.array(F.when(a == "BUILDING", "ABROAD").otherwise(a))))
    return s.select("repo", validation.transitions(F.col("states"), moves, F.lit(""), F.array_intersect("states", F.array(F.lit("MACHINERY"))), F.array().cast("array<struct<src:string,dst:string,why:string>>")).alias("problems"))


@query("""
    with p as (select l_suppkey as repo, list_sort(list_distinct(list(cast(l_partkey as bigint)))) as parts from lineitem group by 1)
    select repo, list_transform(parts[1:3], lambda x: cast(x as varchar)) as first, greatest(len(parts) - 3, 0) as more from p""")
def write_site_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The first three parts of each supplier, and how many more."""
    p = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("repo")).agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    first, more = ranking.first_few(F.col("parts"), 3)
    return p.select("repo", F.transform(first, lambda x: x.cast("string")).alias("first"), more.cast("long").alias("more"))


@query("""
    select c_nationkey as repo, list_sort(list_distinct(list(c_mktsegment))) as kinds, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ' or ') as listed from customer group by 1""")
def all_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The segments of each nation, and as a phrase."""
    one = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("repo")).agg(F.min("c_mktsegment").alias("spine"), F.collect_set("c_mktsegment").alias("rest"))
    every = F.array_sort(F.array_distinct(sets.all_kinds(F.col("spine"), F.col("rest"), F.array().cast("array<string>"))))
    return one.select("repo", every.alias("kinds"), text.or_list(every).alias("listed"))


@query("""
    select doc_id, list_sort(list_distinct(regexp_extract_all(text, '(?m)^([A-Z][a-z]+) ', 1))) as names from documents""")
def line_names(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct capitalised words that open the lines of a document."""
    return read(spark, sf, "documents").select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("(?m)^([A-Z][a-z]+) "), F.lit(1)))).alias("names"))


@query("""
    select distinct doc_id as repo, unnest(regexp_extract_all(text, '(?m)^([A-Z][a-z]+) ', 1)) as name from documents""")
def failed_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as test output in which the lines that open with a capitalised word report a failure: the distinct names."""
    output = read(spark, sf, "documents").select(F.col("doc_id").alias("repo"), F.regexp_replace("text", "(?m)^([A-Z][a-z]+) ", "--- FAIL: $1 ").alias("out"))
    return rollups.failed_names(output, "out")


FINDING_SQL = "select c_nationkey as repo, o_orderkey as ord, o_orderstatus as id, case when o_orderpriority = '1-URGENT' then 'critical' when o_orderpriority = '2-HIGH' then 'high' when o_orderpriority = '3-MEDIUM' then 'medium' else 'info' end as severity, cast(o_custkey as varchar) as place from orders join customer on c_custkey = o_custkey"


def order_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as findings in the nation of their customer."""
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("info")
    nations = read(spark, sf, "customer").select(F.col("c_nationkey").alias("repo"), F.col("c_custkey").alias("o_custkey"))
    place = F.col("o_custkey").cast("string")
    return read(spark, sf, "orders").join(nations, "o_custkey").select("repo", F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("id"), severity.alias("severity"), place.alias("title"), place.alias("place"))


@query(f"""
    with f as ({FINDING_SQL}), s as (select *, row_number() over (partition by repo order by ord) as r from f)
    select repo, array_to_string(list(severity || ' ' || id || ' ' || place order by r) filter (where r <= 12), '; ') as findings, greatest(count(*) - 12, 0) as more from s group by 1""")
def first_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The first twelve findings of each nation, and how many more."""
    shown = rollups.first_findings(order_findings(spark, sf))
    return shown.select("repo", F.array_join(F.transform("findings", lambda x: F.concat_ws(" ", x["severity"], x["id"], x["place"])), "; ").alias("findings"), F.col("more").cast("long").alias("more"))


@query(f"select repo, severity, count(*) as n from ({FINDING_SQL}) group by 1, 2")
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The findings of each nation by severity."""
    return rollups.severities(order_findings(spark, sf))


@query(f"""
    with s as (select s_nationkey as repo, count(*) filter (where s_acctbal > 0) as injectable, count(*) filter (where not s_acctbal > 0) as concrete from supplier group by 1),
    f as (select repo, nullif(count(*) filter (where severity = 'critical'), 0) as critical, nullif(count(*) filter (where severity = 'high'), 0) as high, nullif(count(*) filter (where severity = 'medium'), 0) as medium, nullif(count(*) filter (where severity = 'info'), 0) as info from ({FINDING_SQL}) group by 1),
    n as (select c_nationkey as repo, list_sort(list_distinct(list(c_mktsegment))) as never_assigned from customer where c_acctbal < -900 group by 1)
    select coalesce(s.repo, f.repo, n.repo) as repo, injectable, concrete, critical, high, medium, info, never_assigned from s full join f on s.repo = f.repo full join n on n.repo = coalesce(s.repo, f.repo)""")
def proved_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation: suppliers as boundaries, orders as findings, the segments of deep debtors as states never assigned."""
    seams = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("repo"), (F.col("s_acctbal") > 0).alias("injectable"))
    machines = read(spark, sf, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("repo"), F.array("c_mktsegment").alias("never_assigned"))
    return rollups.proved(seams, order_findings(spark, sf), machines)


@query("""
    with d as (select source as repo, cast(doc_id as varchar) as path, text, lower(text) as low from documents where strlen(text) <= 524288),
    v as (select unnest([{'t': 'law', 'w': 'license'}, {'t': 'law', 'w': 'copyright'}, {'t': 'access', 'w': 'password'}, {'t': 'access', 'w': 'token'}, {'t': 'access', 'w': 'secret'}, {'t': 'small words', 'w': 'with'}, {'t': 'small words', 'w': 'und'}]) as v),
    h as (select repo, path, v.t as topic, sum((strlen(low) - strlen(replace(low, v.w, ''))) // strlen(v.w)) as n from d cross join v where contains(low, v.w) group by 1, 2, 3),
    s as (select repo, path, cast(sum(n + case when n >= 5 then 5 else 0 end) as bigint) as score, list_sort(list(topic)) as topics from h group by 1, 2),
    r as (select *, row_number() over (partition by repo order by score desc, path) as rank from s)
    select repo, path, score, topics, rank from r where rank <= 8""")
def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The eight documents of each source that say most of three topics."""
    words = {"law": ["license", "copyright"], "access": ["password", "token", "secret"], "small words": ["with", "und"]}
    topics = spark.createDataFrame([(t, w) for t, ws in words.items() for w in ws], "topic string, word string")
    docs = read(spark, sf, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text")
    return files.scored_documents(docs, topics).select("repo", "path", "score", "topics", F.col("rank").cast("long").alias("rank"))


@query("""
    with last as (select conv_id, role, arg_max(text, turn) as text from conversations where length(trim(text)) > 0 group by 1, 2) select conv_id, role, md5(text) as digest from last""")
def applied_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The last non-empty turn of each role of a conversation: later valid answers replace earlier ones."""
    turns = read(spark, sf, "conversations").select(F.col("conv_id").alias("repo"), F.col("role").alias("kind"), F.lit("").alias("subject"), F.col("turn").alias("ord"), "text")
    old, new = turns.where("ord < 2"), turns.where("ord >= 2")
    fresh = state.applied(old.where("length(trim(text)) > 0"), new, validation.problems((validation.blank(F.col("text")), "empty")))
    return fresh.select(F.col("repo").alias("conv_id"), F.col("kind").alias("role"), F.md5("text").alias("digest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
