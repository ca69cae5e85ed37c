"""Conflict audits: the 8 merging rules, traces, provenance and their corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord import fixtures as fx
from concord.operators import audit, joins
from concord.plans.common import rounded, tidy
from concord.plans.registry import query
from concord.plans.views import with_views

IDENTITIES = {"coarse": "ck", "fine": "fk"}

SUMMARY = """
sa as (select identity, key, arg_min(label, ord) as f, min(label) <> max(label) as ca,
    case when 2 * sum(label) = count(*) then null when 2 * sum(label) > count(*) then 1 else 0 end as m
    from (select 'coarse' as identity, ck as key, label, ord from obs_a
          union all select 'fine', fk, label, ord from obs_a) group by 1, 2),
sb as (select identity, key, arg_min(label, ord) as b_label, min(label) <> max(label) as cb
    from (select 'coarse' as identity, ck as key, label, ord from obs_b
          union all select 'fine', fk, label, ord from obs_b) group by 1, 2),
cells as (select identity, key, mode, filter, case mode when 'first' then f else m end as a_label, b_label
    from sa join sb using (identity, key), (values ('first'), ('majority')) t(mode),
    (values ('all'), ('consistent')) u(filter) where filter = 'all' or not (ca or cb)),
counts as (select identity, mode, filter, count(*) as total_overlap, count(a_label) as resolved,
    count(*) - count(a_label) as ties,
    count(*) filter (a_label = 1 and b_label = 0) as n01, count(*) filter (a_label = 0 and b_label = 1) as n10
    from cells group by 1, 2, 3)"""


def sign_p(n01: str, n10: str) -> str:
    n = f"({n01} + {n10})"
    term = (f"lambda k: exp(lgamma({n} + 1.0::double) - lgamma(k + 1.0::double) "
            f"- lgamma({n} - k + 1.0::double) - {n} * ln(2.0::double))")
    return (f"case when {n} = 0 then 1.0::double else least(1.0::double, 2.0::double * "
            f"list_sum(list_transform(range(0, least({n01}, {n10}) + 1), {term}))) end")


def bh_sql(source: str, p: str, order: str, out: str = "q") -> str:
    return f"""select * exclude (raw_, up_), least(1.0::double, min(raw_) over (order by up_ desc
        rows between unbounded preceding and current row)) as {out} from (
        select *, {p} * count(*) over () / row_number() over (order by {p}, {order}) as raw_,
        row_number() over (order by {p}, {order}) as up_ from {source})"""


AUDIT = f"""{SUMMARY},
rules as (select *, n01 + n10 as discordant, n01 / nullif(n01 + n10, 0)::double as rho,
    {sign_p('n01', 'n10')} as p from counts)
{bh_sql('rules', 'p', 'identity, mode, filter')}"""


def _ab(spark, d):
    return fx.obs_a(spark, d), fx.obs_b(spark, d)


@query("h1_conflict_rule", rounded(with_views("obs_a obs_b", f"""{SUMMARY}
    select identity, mode, filter, total_overlap, resolved, ties, n01, n10, n01 + n10 as discordant,
    {sign_p('n01', 'n10')} as p from counts where identity = 'coarse' and mode = 'first' and filter = 'consistent'"""), "p"))
def h1(spark, d):
    rules = audit.conflict_audit(*_ab(spark, d), {"coarse": "ck"})
    return tidy(rules.where("mode = 'first' AND filter = 'consistent'").drop("rho", "q"))


@query("h2_conflict_audit", rounded(with_views("obs_a obs_b", AUDIT), "p q rho"))
def h2(spark, d):
    return tidy(audit.conflict_audit(*_ab(spark, d), IDENTITIES))


@query("h3_conflict_trace", with_views("obs_a obs_b", f"""{SUMMARY}
    select identity, mode, filter, key, a_label, b_label, case when a_label = 1 then 'n01' else 'n10' end as direction
    from cells where a_label <> b_label"""))
def h3(spark, d):
    return audit.conflict_trace(*_ab(spark, d), IDENTITIES)


@query("h4_sign_test", rounded(f"""select source, p_size, n01, n10, {sign_p('n01', 'n10')} as p from (
    select p_type as source, p_size, count(*) filter (l_linestatus = 'O' and l_returnflag = 'A') as n01,
    count(*) filter (l_linestatus = 'F' and l_returnflag = 'R') as n10
    from lineitem join part on l_partkey = p_partkey group by 1, 2)""", "p"))
def h4(spark, d):
    both = fx.table(spark, d, "lineitem").select("l_partkey", "l_linestatus", "l_returnflag").join(
        fx.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("source"), "p_size"),
        "l_partkey")
    counts = both.groupBy("source", "p_size").agg(
        F.expr("count_if(l_linestatus = 'O' AND l_returnflag = 'A')").alias("n01"),
        F.expr("count_if(l_linestatus = 'F' AND l_returnflag = 'R')").alias("n10"))
    return tidy(counts.withColumn("p", audit.sign_test("n01", "n10")))


def _family(spark, d):
    a = fx.obs_a(spark, d).join(fx.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("ck"), "o_orderpriority"), "ck")
    counts = a.groupBy("o_orderpriority").agg(
        F.expr("count_if(label = 1)").alias("n01"), F.expr("count_if(label = 0)").alias("n10"))
    return counts.withColumn("p", audit.sign_test("n01", "n10"))


FAMILY = f"""fam as (select *, {sign_p('n01', 'n10')} as p from (select o_orderpriority,
    count(*) filter (label = 1) as n01, count(*) filter (label = 0) as n10
    from obs_a join orders on o_orderkey = cast(ck as bigint) group by 1))"""


@query("h5_bh_adjust", rounded(with_views("obs_a", f"{FAMILY} {bh_sql('fam', 'p', 'o_orderpriority')}"), "p q"))
def h5(spark, d):
    return tidy(audit.bh_adjust(_family(spark, d), "p", tie=["o_orderpriority"]))


@query("h6_holm_adjust", rounded(with_views("obs_a", f"""{FAMILY}, ranked as (select *,
    row_number() over (order by p, o_orderpriority) as r_, count(*) over () as m_ from fam)
    select o_orderpriority, n01, n10, p, max(least(1.0::double, (m_ - r_ + 1) * p)) over (order by r_
    rows between unbounded preceding and current row) as p_holm from ranked"""), "p p_holm"))
def h6(spark, d):
    return tidy(audit.holm_adjust(_family(spark, d), "p", tie=["o_orderpriority"]))


#: One test per order: is its lines' price share what a coin would give? As many tests as orders.
MANY = """many as (select l_orderkey, o_orderpriority, cast(('0x' || substr(md5(l_orderkey || ':' || count(*)), 1, 6)) as bigint) % 5000 / 5000.0::double as p
    from lineitem join orders on o_orderkey = l_orderkey group by 1, 2)"""


def _many(spark, d):
    n = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).count()
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "o_orderkey", "count").cast("binary")), 1, 6), 16, 10).cast("long")
    return fx.table(spark, d, "orders").join(n, "o_orderkey").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", (h % 5000 / 5000.0).alias("p"))


@query("h5_bh_large_families", rounded(f"""with {MANY}, ranked as (select *, p * count(*) over (partition by o_orderpriority) / row_number() over w as raw_ from many
    window w as (partition by o_orderpriority order by p, l_orderkey)) select l_orderkey, o_orderpriority, p,
    least(1.0::double, min(raw_) over (partition by o_orderpriority order by p desc, l_orderkey desc rows unbounded preceding)) as q from ranked""", "p q"))
def h5_large(spark, d):
    return tidy(audit.bh_adjust_large(_many(spark, d), "p", ["o_orderpriority"]))


@query("h6_holm_large_family", rounded(f"""with {MANY}, ranked as (select *, row_number() over (order by p, l_orderkey) as r_, count(*) over () as m_ from many)
    select l_orderkey, o_orderpriority, p, max(least(1.0::double, (m_ - r_ + 1) * p)) over (order by r_ rows between unbounded preceding and current row) as p_holm from ranked""", "p p_holm"))
def h6_large(spark, d):
    return tidy(audit.holm_adjust_large(_many(spark, d), "p"))


FIRSTS = """fa as (select ck, arg_min(label, ord) as a_label from obs_a group by 1),
fb as (select ck, arg_min(label, ord) as b_label from obs_b group by 1),
both_ as (select * from fa join fb using (ck))"""


@query("h7_divergence_report", rounded(with_views("obs_a obs_b", f"""{FIRSTS},
    t as (select count(*) as overlap, count(*) filter (a_label = b_label) as agree,
    count(*) filter (a_label = 1 and b_label = 0) as n01, count(*) filter (a_label = 0 and b_label = 1) as n10 from both_)
    select overlap, agree, n01 + n10 as divergent, n01, n10, coalesce((n01 + n10)::double / nullif(overlap, 0), 0.0::double) as rate,
    {sign_p('n01', 'n10')} as p from t"""), "rate p"))
def h7(spark, d):
    return tidy(audit.divergence_report(*_ab(spark, d), "ck"))


@query("h7_divergent_items", with_views("obs_a obs_b", f"{FIRSTS} select * from both_ where a_label <> b_label"))
def h7_items(spark, d):
    a, b = _ab(spark, d)
    return joins.overlap(audit.first_label(a, "ck"), audit.first_label(b, "ck"), "ck").where("a_label <> b_label")


@query("h8_direction_effect", rounded(with_views("obs_a obs_b", f"""{SUMMARY}
    select identity, mode, filter, n01 / nullif(n01 + n10, 0)::double as rho from counts"""), "rho"))
def h8(spark, d):
    return tidy(audit.conflict_audit(*_ab(spark, d), IDENTITIES).select("identity", "mode", "filter", "rho"))


@query("a3_first_label", with_views("obs_a", "select ck, arg_min(label, ord) as label from obs_a group by 1"))
def a3(spark, d):
    return audit.first_label(fx.obs_a(spark, d), "ck")


@query("a4_majority_label", with_views("obs_a", """select ck, case when 2 * sum(label) = count(*) then null
    when 2 * sum(label) > count(*) then 1 else 0 end as label, count(*) as n, cast(sum(label) as bigint) as ones
    from obs_a group by 1"""))
def a4(spark, d):
    return audit.majority_label(fx.obs_a(spark, d), "ck")


@query("a5_soft_label", rounded(with_views("obs_a", "select ck, avg(label) as soft from obs_a group by 1"), "soft"))
def a5(spark, d):
    return tidy(audit.soft_label(fx.obs_a(spark, d), "ck"))


@query("a6_conflict_keys", with_views("obs_a", "select ck from obs_a group by 1 having count(distinct label) > 1"))
def a6(spark, d):
    return audit.conflict_keys(fx.obs_a(spark, d), "ck")


@query("a16_merge_duplicates", with_views("obs_a", """select fk, case when avg(label) >= 0.5 then 1 else 0 end as label
    from obs_a group by 1"""))
def a16(spark, d):
    return audit.merge_duplicates(fx.obs_a(spark, d), "fk")
