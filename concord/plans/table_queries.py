"""Sources, projections, keys, joins and aggregations over the fixture views."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from concord import fixtures as fx
from concord.functions import columns as c, keys
from concord.operators import aggregate as agg, contracts as con, joins
from concord.operators.audit import first_label
from concord.operators.ranking import first_rows
from concord.plans.common import rounded, tidy
from concord.plans.registry import query
from concord.plans.views import with_views
from concord.session import cut_lineage, shared_folder
from concord.sources import files

# ---- sources and sinks -----------------------------------------------------


def _scratch(spark) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_folder(spark)}/run-{os.urandom(6).hex()}"


def _parts(spark, d):
    return fx.assay(spark, d).select("id", "ordinal", "measure", "ord")


@query("s1_read_csv", with_views("assay", "select id, ordinal, measure, cast(ord as varchar) as ord from assay"))
def s1(spark, d):
    path = _scratch(spark)
    files.write_table(_parts(spark, d), path, "csv")
    return files.read_strings(spark, path)


@query("s2_read_tsv", with_views("assay", "select id, ordinal, measure, cast(ord as varchar) as ord from assay"))
def s2(spark, d):
    path = _scratch(spark)
    _parts(spark, d).write.option("header", True).option("sep", "\t").csv(path)
    return files.read_strings(spark, path, sep="\t")


@query("s3_read_xml", with_views("assay", "select id as \"Id\", measure as \"InChI\" from assay"))
def s3(spark, d):
    path = _scratch(spark)
    rows = _parts(spark, d).select(F.col("id").alias("Id"), F.col("measure").alias("InChI"))
    rows.write.format("xml").option("rowTag", "Compound").option("rootTag", "Set").save(path)
    return files.read_xml(spark, path, "Compound", "Id string, InChI string")


@query("s4_read_key_value", with_views("assay", "select id as key, measure as value from assay"))
def s4(spark, d):
    path = _scratch(spark)
    rows = _parts(spark, d).select(F.concat_ws("\t", "id", "measure").alias("value"))
    spark.createDataFrame([("id\tvalue",)], "value string").unionByName(rows).write.text(path)
    return files.read_key_value(spark, path, "id\tvalue")


@query("s5_read_report", with_views("assay", "select id, measure from assay where ordinal = 'SMALL' and ord = 1"))
def s5(spark, d):
    path = _scratch(spark)
    entry = F.array(F.struct("id", "ordinal", "measure", "ord")).alias("rules")
    _parts(spark, d).select(entry).write.json(path)
    schema = "rules array<struct<id:string,ordinal:string,measure:string,ord:int>>"
    rows = files.read_report(spark, path, "rules", schema, multi_line=False, ordinal="SMALL", ord=1)
    return rows.select("id", "measure")


@query("s6_drop_non_numeric_key", with_views("assay", """mixed as (select id, measure from assay
    union all select 'x' || ordinal, measure from assay)
    select try_cast(id as bigint) as id, measure from mixed where try_cast(id as bigint) is not null"""))
def s6(spark, d):
    base = fx.assay(spark, d)
    mixed = base.select("id", "measure").unionByName(
        base.select(F.concat(F.lit("x"), "ordinal").alias("id"), "measure"))
    return files.drop_non_numeric_key(mixed, "id")


@query("s7_write_csv", with_views("obs_c", "select ck, count(*) as n from obs_c group by 1"))
def s7(spark, d):
    path = _scratch(spark)
    files.write_table(agg.crosstab(fx.obs_c(spark, d), ["ck"]), path, "csv")
    return files.read_strings(spark, path).withColumn("n", c.to_double("n").cast("bigint"))


@query("s8_write_json", with_views("obs_c", "select ck, count(*) as n from obs_c group by 1"))
def s8(spark, d):
    path = _scratch(spark)
    files.write_table(agg.crosstab(fx.obs_c(spark, d), ["ck"]), path, "json")
    return spark.read.schema("ck string, n bigint").json(path)


@query("s9_prediction_bundle", with_views("pred", "select item_id, gold, view, arm from pred where view = 1 and arm = 'B'"))
def s9(spark, d):
    path = _scratch(spark)
    files.write_predictions(fx.predictions(spark, d), path)
    return files.read_predictions(spark, path).where("view = 1 AND arm = 'B'").select("item_id", "gold", "view", "arm")


@query("s10_compare_tables", """with a as (select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey % 10 <> 3),
    b as (select o_orderkey, case when o_orderkey % 7 = 0 then -1 else o_custkey end as o_custkey, o_orderstatus
    from orders where o_custkey % 10 <> 4)
    select o_orderkey, a.o_custkey is not null as in_a, b.o_custkey is not null as in_b,
    sha256('+' || a.o_custkey || chr(31) || '+' || o_orderkey || chr(31) || '+' || a.o_orderstatus) as digest_a,
    sha256('+' || b.o_custkey || chr(31) || '+' || o_orderkey || chr(31) || '+' || b.o_orderstatus) as digest_b,
    a.o_custkey is not distinct from b.o_custkey and a.o_orderstatus is not distinct from b.o_orderstatus as identical
    from a full outer join b using (o_orderkey)""")
def s10(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    a = o.where("o_custkey % 10 <> 3")
    b = o.where("o_custkey % 10 <> 4").withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("o_custkey")))
    return con.compare_tables(a, b, ["o_orderkey"])


@query("s11_file_manifest")
def s11(spark, d):
    names = ["lineitem.parquet", "orders.parquet", "part.parquet", "not_there.parquet"]
    return files.file_manifest(spark, f"{d}/*.parquet", names)


@query("s12_row_counts", " union all ".join(
    f"select '{t}' as source, count(*) as n_rows, count(*) > 0 as present from {t}" for t in ("part", "orders", "lineitem", "events")))
def s12(spark, d):
    return con.row_counts({t: fx.table(spark, d, t) for t in ("part", "orders", "lineitem", "events")})


# ---- projections and contracts ---------------------------------------------

@query("p1_binary_label", "select o_orderkey, case when o_orderstatus = 'F' then 1 else 0 end as label from orders")
def p1(spark, d):
    return fx.table(spark, d, "orders").select(
        "o_orderkey", c.binary_label(F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")), "F").alias("label"))


@query("p2_parse_label", """select o_orderkey, case o_orderstatus when 'F' then 0.0::double when 'O' then 1.0::double end as label
    from orders""")
def p2(spark, d):
    text = F.when(F.col("o_orderstatus") == "F", " 0.0").when(F.col("o_orderstatus") == "O", "1 ").otherwise("nan")
    return fx.table(spark, d, "orders").select("o_orderkey", c.parse_label(text).alias("label"))


@query("p3_to_double", with_views("assay", "select id, ord, try_cast(measure as double) as value from assay"))
def p3(spark, d):
    return fx.assay(spark, d).select("id", "ord", c.to_double("measure").alias("value"))


@query("p4_require_key", "select event_id, nullif(case event_type when 'view' then '' else event_type end, '') as key from events where event_type <> 'view'")
def p4(spark, d):
    blank = F.when(F.col("event_type") == "view", "  ").otherwise(F.col("event_type"))
    df = fx.table(spark, d, "events").select("event_id", c.blank_to_null(blank).alias("key"))
    return con.require_key(df, "key")


CENSORED = "cast(replace(measure, '>', '') as double)"


@query("p5_parse_censored", with_views("assay", f"select id, ord, {CENSORED} as value, measure like '>%' as censored from assay"))
def p5(spark, d):
    value, censored = c.parse_censored("measure")
    return fx.assay(spark, d).select("id", "ord", value.alias("value"), censored.alias("censored"))


VARIANTS = f"""variants as (select id, ord, ordinal, {CENSORED} as value,
    case when ordinal in ('STANDARD', 'LARGE', 'MEDIUM') then 1 else 0 end as y from assay)"""


def _variants(spark, d):
    value, _ = c.parse_censored("measure")
    return fx.assay(spark, d).select("id", "ord", "ordinal", value.alias("value")).withColumns(
        c.label_variants("ordinal", "value", ["STANDARD", "LARGE", "MEDIUM"], 10.0))


@query("p6_label_variants", with_views("assay", f"""{VARIANTS} select *, case when value = 10 then 0 else y end as y_low,
    case when value = 10 then 1 else y end as y_high from variants"""))
def p6(spark, d):
    return _variants(spark, d)


@query("p7_expect", with_views("assay", """seen as (select count(*)::double as n_rows, count(distinct id)::double as n_ids,
    count(*) filter (ordinal = 'SMALL')::double as n_small, max(ord)::double as max_ord from assay)
    select u.rule, u.observed, u.expected, u.observed is not distinct from u.expected as ok from seen,
    unnest([{rule: 'n_rows', observed: n_rows, expected: 2000.0::double}, {rule: 'n_ids', observed: n_ids, expected: 2000.0::double},
    {rule: 'n_small', observed: n_small, expected: 1.0::double}, {rule: 'max_ord', observed: max_ord, expected: 1.0::double}]) t(u)"""))
def p7(spark, d):
    return con.expect(fx.assay(spark, d), {
        "n_rows": (F.count(F.lit(1)), 2000), "n_ids": (F.count_distinct("id"), 2000),
        "n_small": (F.count_if(F.col("ordinal") == "SMALL"), 1), "max_ord": (F.max("ord"), 1)})


@query("p7_duplicate_keys", with_views("assay", """select cast(sum(n) as bigint) as n_rows, count(*) as n_keys,
    count(*) filter (n > 1) as n_repeated from (select id, count(*) as n from assay group by 1)"""))
def p7_keys(spark, d):
    return con.duplicate_keys(fx.assay(spark, d), "id")


@query("p8_round", "select o_orderkey, round_even(o_totalprice / 8.0::double, 1) as half_even from orders")
def p8(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", F.bround(F.col("o_totalprice") / F.lit(8.0), 1).alias("half_even"))


MERGED = """ka as (select ck, arg_min(label, ord) as a_label from obs_a group by 1),
kb as (select ck, arg_min(label, ord) as b_label from obs_b group by 1),
kc as (select ck, min(value) as lo, max(value) as hi, avg(value) as mean_value, arg_min(value, ord) as first_value from obs_c group by 1),
merged as (select * from ka full outer join kb using (ck) left join kc using (ck))"""


def _merged(spark, d):
    a = first_label(fx.obs_a(spark, d), "ck").withColumnRenamed("label", "a_label")
    b = first_label(fx.obs_b(spark, d), "ck").withColumnRenamed("label", "b_label")
    v = fx.obs_c(spark, d).groupBy("ck").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean_value"),
        F.min_by("value", "ord").alias("first_value"))
    return a.join(b, "ck", "full_outer").join(v, "ck", "left")


@query("p9_disagreement_flags", with_views("obs_a obs_b obs_c", f"""{MERGED} select ck, coalesce(a_label <> b_label, false) as labels_differ,
    coalesce((first_value > 0 and b_label = 0) or (first_value < 0 and b_label = 1), false) as sign_contradicts from merged"""))
def p9(spark, d):
    return _merged(spark, d).select(
        "ck", c.labels_differ("a_label", "b_label").alias("labels_differ"),
        c.sign_contradicts("first_value", "b_label").alias("sign_contradicts"))


@query("p10_range_check", rounded(with_views("obs_a obs_b obs_c", f"""{MERGED} select ck, (lo + hi) / 2 as mid,
    abs(first_value - (lo + hi) / 2) as abs_diff, case when first_value is null then null
    when first_value between lo and hi then 1 else 0 end as within from merged"""), "mid abs_diff"))
def p10(spark, d):
    return tidy(_merged(spark, d).select("ck", *[e.alias(n) for n, e in c.range_check("first_value", "lo", "hi").items()]))


@query("p11_bucketize", """select l_suppkey, count(*) as n, case when count(*) > 620 then '>620' when count(*) > 600 then '601-620'
    when count(*) > 580 then '581-600' else '1-580' end as bin from lineitem group by 1""")
def p11(spark, d):
    n = agg.crosstab(fx.table(spark, d, "lineitem"), ["l_suppkey"])
    return n.withColumn("bin", c.bucketize("n", [0, 580, 600, 620], ["1-580", "581-600", "601-620", ">620"]))


@query("p12_conflict_status", with_views("obs_a obs_b obs_c", f"""{MERGED} select ck, case when a_label is null or b_label is null
    then 'missing' when a_label <> b_label then 'conflict' else 'nonconflict' end as status from merged"""))
def p12(spark, d):
    return _merged(spark, d).select("ck", c.conflict_status("a_label", "b_label").alias("status"))


# ---- keys ------------------------------------------------------------------

@query("k1_identity_keys", """select doc_id, md5(lower(regexp_replace(trim(text, ' '), '[ \\t\\n\\r\\f]+', ' ', 'g'))) as fine_key,
    md5(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))), ' '), '')) as coarse_key from documents""")
def k1(spark, d):
    fine = F.md5(F.lower(F.regexp_replace(F.trim("text"), "[ \\t\\n\\r\\f]+", " ")).cast("binary"))
    df = keys.identity_keys(fx.table(spark, d, "documents"), "text", fine, keys.word_set(F.col("text")))
    return df.select("doc_id", "fine_key", "coarse_key")


def _word_keys(text: str):
    """Words in the order of their first place, and a checksum that no built-in function has."""
    words = text.lower().split()
    if not words:
        raise ValueError("no words")
    total = 7
    for w in words:
        total = (total * 31 + len(w)) % 1000003
    return " ".join(words), str(total)


@query("k1_identity_keys_user_function", """with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as ws from documents)
    select doc_id, array_to_string(ws, ' ') as fine_key,
    cast(list_reduce(list_prepend(7::bigint, list_transform(ws, lambda x: length(x)::bigint)), lambda a, b: (a * 31 + b) % 1000003) as varchar) as coarse_key from w""")
def k1_user(spark, d):
    return keys.identity_keys_with(fx.table(spark, d, "documents"), "text", _word_keys).select("doc_id", "fine_key", "coarse_key")


def _plain_key():
    """A key that fails for texts with a digit anywhere."""
    return F.when(~F.col("text").rlike("[0-9]"), keys.word_set(F.col("text")))


@query("k2_quarantine", """with keyed as (select doc_id, case when regexp_matches(text, '[0-9]') then null else md5(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))), ' '), '')) end as k from documents)
    select doc_id, 'documents' as source, 'key failed' as reason from keyed where k is null""")
def k2(spark, d):
    keyed = fx.table(spark, d, "documents").select("doc_id", F.lit("documents").alias("source"), _plain_key().alias("k"))
    return con.quarantine(keyed, "k", "key failed")[1].drop("k")


@query("k3_parse_rate", rounded("""select 'documents' as source, count(k) as parsed, count(*) as total, count(k) / count(*)::double as rate
    from (select case when regexp_matches(text, '[0-9]') then null else md5(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))), ' '), '')) end as k from documents)
    union all select 'benchmark', count(k), count(*), count(k) / count(*)::double
    from (select case when regexp_matches(text, '[0-9]') then null else md5(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))), ' '), '')) end as k from benchmark)""", "rate"))
def k3(spark, d):
    return tidy(con.parse_rate({t: (fx.table(spark, d, t).select(_plain_key().alias("k")), "k") for t in ("documents", "benchmark")}))


@query("k4_key_ladder", """with l as (select *, nullif(regexp_replace(lower(text), '[^a-z]', '', 'g'), '') as le from documents)
    select doc_id, md5(text) as exact, md5(lower(text)) as folded,
    md5(regexp_replace(lower(text), '[ \\t\\n\\r\\f]+', '', 'g')) as spaceless, md5(le) as letters, md5(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))), ' '), '')) as words,
    contains(trim(text, ' '), chr(10)) as multi_part, le is not null as ok from l""")
def k4(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", *[e.alias(n) for n, e in keys.key_ladder("text").items()])


@query("k5_hashed_features")
def k5(spark, d):
    from pyspark.ml.functions import vector_to_array

    df = keys.hashed_features(fx.table(spark, d, "documents"), "text")
    return df.select("doc_id", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x).alias("bits_set"))


@query("k6_group_key", """select doc_id, coalesce(k, 'INVALID') as grp from (select doc_id, case when regexp_matches(text, '[0-9]') then null else md5(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))), ' '), '')) end as k from documents)""")
def k6(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", keys.group_key(_plain_key()).alias("grp"))


VOCAB = """v as (select 'lang' as "column", lang as value, row_number() over (order by lang) as slot
    from (select distinct lang from documents)
    union all select 'source', source, row_number() over (order by source) from (select distinct source from documents))"""


@query("k7_fit_vocab", f"with {VOCAB} select \"column\", value, cast(slot as integer) as slot from v")
def k7(spark, d):
    return keys.fit_vocab(fx.table(spark, d, "documents"), ["lang", "source"])


@query("k7_one_hot", """with v as (select lang, row_number() over (order by lang) as slot from (select distinct lang from documents where lang <> 'en')),
    w as (select max(slot) as width from v)
    select doc_id, cast(coalesce(slot, 0) as integer) as lang_slot,
    list_transform(range(0, width + 1), lambda i: case when i = coalesce(slot, 0) then 1 else 0 end) as lang_hot
    from documents left join v using (lang), w""")
def k7_hot(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang")
    vocab = keys.fit_vocab(docs.where("lang <> 'en'"), ["lang"])
    return keys.one_hot(docs, vocab, ["lang"]).select("doc_id", "lang_slot", "lang_hot")


@query("k8_mean_pool", """select label, list(x order by pos) as pooled from (
    select label, pos, round(sum(case when vec_id % 3 > 0 then v else 0.0::double end) / greatest(sum(case when vec_id % 3 > 0 then 1.0::double else 0.0::double end), 1.0::double), 6) + 0.0::double as x
    from (select label, vec_id, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding)::double as v from embeddings) group by 1, 2) group by 1""")
def k8(spark, d):
    v = fx.vectors(spark, d).withColumn("mask", (F.col("vec_id") % 3 > 0).cast("int"))
    return tidy(keys.mean_pool(v, "label", "embedding", "mask"))


# ---- joins -----------------------------------------------------------------

CONS = """ca as (select ck, list_sort(list(distinct label)) as raw, arg_min(label, ord) as label, case when min(label) <> max(label) then 1 else 0 end as conflict
    from obs_a group by 1),
cb as (select ck, list_sort(list(distinct label)) as raw, arg_min(label, ord) as label, case when min(label) <> max(label) then 1 else 0 end as conflict
    from obs_b group by 1)"""


@query("j1_merge_channels", with_views("obs_a obs_b", f"""{CONS} select ck, ca.raw as a_raw_labels, ca.label as a_label, ca.conflict as a_conflict,
    cb.raw as b_raw_labels, cb.label as b_label, cb.conflict as b_conflict,
    case when ca.label is not null and cb.label is not null then 1 else 0 end as overlap,
    case when ca.label <> cb.label then 1 else 0 end as divergence,
    case when ca.label is not null and cb.label is not null then 'overlap' when cb.label is not null then 'b_only' else 'a_only' end as source
    from ca full outer join cb using (ck)"""))
def j1(spark, d):
    return joins.merge_channels(
        agg.consolidate(fx.obs_a(spark, d), "ck"), agg.consolidate(fx.obs_b(spark, d), "ck"), "ck")


@query("j2_overlap", with_views("obs_a obs_b", f"""{MERGED.split('kc as')[0].rstrip().rstrip(',')}
    select * from ka join kb using (ck)"""))
def j2(spark, d):
    return joins.overlap(first_label(fx.obs_a(spark, d), "ck"), first_label(fx.obs_b(spark, d), "ck"), "ck")


@query("j3_left_enrichment", """select l_orderkey, l_linenumber, l_partkey, p_brand from lineitem left join (select * from part where p_size > 20) on l_partkey = p_partkey""")
def j3(spark, d):
    part = fx.table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey", "left")


@query("j4_join_many_to_one", with_views("assay", """one as (select id, min(row(ordinal, measure)) as m, count(*) as n from assay group by 1)
    select l_orderkey, l_linenumber, cast(l_partkey as varchar) as id, ordinal, measure, coalesce(n, 0) as right_rows
    from lineitem left join (select id, n, m[1] as ordinal, m[2] as measure from one) on id = cast(l_partkey as varchar)"""))
def j4(spark, d):
    left = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("id"))
    return joins.join_many_to_one(left, fx.assay(spark, d).select("id", "ordinal", "measure"), "id", repeated="first")


@query("j5_tiered_match", with_views("docs", """l as (select * from docs where lang = 'en'), r as (select * from docs where quality is not null),
    hits as (select x.id as left_id, y.id as right_id, 'canon' as match, 0 as tier from
    (select canon_key as k, min(doc_id) as id from l group by 1) x join (select canon_key as k, min(doc_id) as id from r group by 1) y using (k)
    union all select x.id, y.id, 'parent', 1 from (select parent_key as k, min(doc_id) as id from l where parent_key is not null group by 1) x
    join (select parent_key as k, min(doc_id) as id from r where parent_key is not null group by 1) y using (k))
    select left_id, right_id, match from (select *, row_number() over (partition by left_id order by tier, right_id) as rn from hits) where rn = 1"""))
def j5(spark, d):
    # Both sides read the keys, which are made once of each text.
    docs = cut_lineage(fx.docs(spark, d).select("doc_id", "lang", "quality", "canon_key", "parent_key").where("lang = 'en' OR quality IS NOT NULL"))
    return joins.tiered_match(docs.where("lang = 'en'"), docs.where("quality IS NOT NULL"),
                              {"canon": "canon_key", "parent": "parent_key"}, "doc_id", "doc_id")


LADDER = """k as (select doc_id, source, md5(text) as exact, md5(lower(text)) as folded,
    md5(regexp_replace(lower(text), '[ \\t\\n\\r\\f]+', '', 'g')) as spaceless,
    md5(nullif(regexp_replace(lower(text), '[^a-z]', '', 'g'), '')) as letters,
    md5(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))), ' '), '')) as words,
    contains(trim(text, ' '), chr(10)) as multi_part from documents),
l as (select * from k where source in ('src0', 'src1', 'src2', 'src3')), r as (select * from k where source not in ('src0', 'src1', 'src2', 'src3'))"""


def _ladder_sides(spark, d):
    k = fx.table(spark, d, "documents").select("doc_id", "source", *[e.alias(n) for n, e in keys.key_ladder("text").items()])
    few = F.col("source").isin("src0", "src1", "src2", "src3")
    return k.where(few), k.where(~few)


@query("j6_overlap_flags", f"""with {LADDER}, f as (select doc_id, multi_part,
    coalesce(exact in (select exact from r where exact is not null), false) as o_exact,
    coalesce(folded in (select folded from r where folded is not null), false) as o_folded,
    coalesce(spaceless in (select spaceless from r where spaceless is not null), false) as o_spaceless,
    coalesce(letters in (select letters from r where letters is not null), false) as o_letters,
    coalesce(words in (select words from r where words is not null), false) as o_words from l)
    select doc_id, o_exact, o_folded, o_spaceless, o_letters, o_words, o_words and not o_exact and multi_part as coarse_only_fragments,
    o_words and not o_exact and not multi_part as coarse_only_single from f""")
def j6(spark, d):
    left, right = _ladder_sides(spark, d)
    names = ("exact", "folded", "spaceless", "letters", "words")
    out = joins.overlap_flags(left, {f"o_{n}": (right, n) for n in names})
    out = out.withColumns(joins.derived_overlap("o_words", "o_exact", F.col("multi_part")))
    return out.select("doc_id", *[f"o_{n}" for n in names], "coarse_only_fragments", "coarse_only_single")


@query("j7_exclude_seen", f"with {LADDER} select doc_id, words from l where words is null or words not in (select words from r where words is not null)")
def j7(spark, d):
    left, right = _ladder_sides(spark, d)
    return joins.exclude_seen(left, right, "words").select("doc_id", "words")


@query("j8_lookup", """select l_orderkey, l_linenumber, l_partkey, coalesce(p_brand, 'unknown') as p_brand from lineitem
    left join (select * from part where p_size > 20) on l_partkey = p_partkey""")
def j8(spark, d):
    part = fx.table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return joins.lookup(lines, part, "l_partkey", "p_brand", "unknown")


@query("j9_pairwise_identity", rounded(with_views("pred", """select l.arm as "left", r.arm as "right", count(*) as n,
    count(*) filter (abs(l.pred - r.pred) > 1e-8 + 1e-5 * abs(r.pred)) as different, max(abs(l.pred - r.pred)) as max_abs_diff,
    corr(l.pred, r.pred) as correlation from pred l join pred r using (item_id) where l.arm < r.arm group by 1, 2"""), "max_abs_diff correlation"))
def j9(spark, d):
    return tidy(joins.pairwise_identity(fx.predictions(spark, d), "item_id", "arm", "pred"))


@query("j10_cluster_members", with_views("obs_a obs_b", "select ck, fk from obs_a intersect select ck, fk from obs_b"))
def j10(spark, d):
    return joins.cluster_members(fx.obs_a(spark, d), fx.obs_b(spark, d), "ck", "fk")


@query("j11_item_refs", with_views("obs_a", "select distinct ck, ref from obs_a"))
def j11(spark, d):
    return joins.item_refs(fx.obs_a(spark, d), "ck")


@query("j12_check_alignment", """with a as (select event_id, event_type, value from events where user_id % 5 <> 0),
    b as (select event_id, case when event_id % 11 = 0 then 'x' else event_type end as event_type, value from events where user_id % 5 <> 1),
    j as (select a.event_id as ka, b.event_id as kb, a.event_type as ea, b.event_type as eb, a.value as va, b.value as vb
    from a full outer join b on a.event_id = b.event_id)
    select count(*) filter (kb is null) as only_a, count(*) filter (ka is null) as only_b,
    count(*) filter (ka is not null and kb is not null and ea is distinct from eb) as differ_event_type,
    count(*) filter (ka is not null and kb is not null and va is distinct from vb) as differ_value from j""")
def j12(spark, d):
    e = fx.table(spark, d, "events").select("event_id", "event_type", "value", "user_id")
    b = e.where("user_id % 5 <> 1").withColumn(
        "event_type", F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("event_type")))
    return joins.check_alignment(e.where("user_id % 5 <> 0"), b, "event_id", ["event_type", "value"])


# ---- aggregations ----------------------------------------------------------

@query("a1_consolidate", with_views("obs_a", """select ck, list_sort(list(distinct label)) as raw_labels, arg_min(label, ord) as label,
    case when count(distinct label) > 1 then 1 else 0 end as conflict, arg_min(fk, ord) as fk, list_sort(list(distinct ref)) as refs,
    cast(count(distinct ref) as integer) as n_refs from obs_a group by 1"""))
def a1(spark, d):
    return agg.consolidate(fx.obs_a(spark, d), "ck", "refs", first=["fk"])


@query("a2_summarise_values", rounded(with_views("obs_c", """select ck, list_sort(list(round(value, 3) + 0.0::double)) as "values", round(min(value), 3) as value_min,
    round(max(value), 3) as value_max, count(*) as value_n, sum(value) as value_sum, list_sort(list(distinct ref)) as value_refs from obs_c group by 1"""),
    "value_min value_max value_sum"))
def a2(spark, d):
    return tidy(agg.summarise_values(fx.obs_c(spark, d), "ck"))


REFS = "r as (select distinct ck, ref from obs_a)"


@query("a7_ref_frequency", rounded(with_views("obs_a", f"""{REFS} select ref, count(*) as n_items,
    count(*) / (select count(distinct ck) from r)::double as share from r group by 1"""), "share"))
def a7(spark, d):
    return tidy(agg.ref_frequency(joins.item_refs(fx.obs_a(spark, d), "ck"), "ck"))


@query("a8_ref_distribution", rounded(with_views("obs_a", f"""{REFS}, s as (select ck, count(*) as n_refs from r group by 1)
    select n_refs, count(*) as n_items, count(*) / (select count(*) from s)::double as share, case when n_refs >= 2 then 1 else 0 end as multi_source
    from s group by 1"""), "share"))
def a8(spark, d):
    return tidy(agg.ref_distribution(joins.item_refs(fx.obs_a(spark, d), "ck"), "ck"))


@query("a9_group_sizes", with_views("obs_a", f"""{REFS}, s as (select ref, count(*) as n from r group by 1) select count(*) as groups,
    min(n) as size_min, quantile_cont(n, 0.5)::double as size_median, max(n) as size_max from s"""))
def a9(spark, d):
    counts = agg.ref_frequency(joins.item_refs(fx.obs_a(spark, d), "ck"), "ck")
    return agg.group_size_summary(counts, "n_items")


@query("a10_crosstab", "select l_returnflag, l_linestatus, l_linenumber, count(*) as n from lineitem group by 1, 2, 3")
def a10(spark, d):
    return agg.crosstab(fx.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


def _stats_sql(by: str, metrics: str, source: str) -> str:
    parts = ", ".join(f"avg({m}) as {m}_mean, stddev_samp({m}) as {m}_sd, min({m}) as {m}_min, max({m}) as {m}_max" for m in metrics.split())
    return f"select {by}, count(*) as n, {parts} from {source} group by {by}"


@query("a11_summary_stats", rounded(_stats_sql("l_returnflag", "l_quantity l_discount l_extendedprice", "lineitem"),
    " ".join(f"{m}_{s}" for m in ("l_quantity", "l_discount", "l_extendedprice") for s in ("mean", "sd", "min", "max")), 4))
def a11(spark, d):
    return tidy(agg.summary_stats(fx.table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_extendedprice"]), 4)


@query("a14_two_flag_stats", rounded(_stats_sql("l_returnflag, l_linestatus", "l_quantity", "lineitem"), "l_quantity_mean l_quantity_sd l_quantity_min l_quantity_max"))
def a14(spark, d):
    return tidy(agg.summary_stats(fx.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"]))


@query("a15_collapse", rounded(with_views("assay", f"""select id, arg_min(ordinal, ord) as ordinal, avg({CENSORED}) as value,
    max(measure like '>%') as censored, string_agg(measure, '|' order by ord) as measure from assay group by 1"""), "value"))
def a15(spark, d):
    value, censored = c.parse_censored("measure")
    df = fx.assay(spark, d).withColumns({"value": value, "censored": censored})
    return tidy(agg.collapse(df, "id", {"ordinal": "first", "value": "mean", "censored": "max", "measure": "text"}, "ord"))


@query("a17_within_variance", rounded(with_views("obs_c", """per as (select ck, count(*) as n, var_pop(value) as v from obs_c group by 1)
    select count(*) filter (n >= 2) as n_repeated, avg(v) filter (n >= 2) as within, (select var_pop(value) from obs_c) as overall,
    coalesce(avg(v) filter (n >= 2), (select var_pop(value) from obs_c)) as variance from per"""), "within overall variance", 9))
def a17(spark, d):
    return tidy(agg.within_variance(fx.obs_c(spark, d), "ck"), 9)


@query("a18_channel_labels", rounded(with_views("obs_a obs_b", """x as (select ck, arg_min(label, ord)::double as a_label, count(*) as a_n from obs_a group by 1),
    y as (select ck, arg_min(label, ord)::double as b_label, count(*) as b_n from obs_b group by 1)
    select ck, a_label as hard, case when a_label is null then b_label when b_label is null then a_label else (a_label + b_label) / 2 end as majority,
    (coalesce(a_label * a_n, 0) + coalesce(b_label * b_n, 0)) / (coalesce(a_n, 0) + coalesce(b_n, 0))::double as weighted
    from x full outer join y using (ck)"""), "hard majority weighted"))
def a18(spark, d):
    m = agg.consensus(fx.obs_a(spark, d), fx.obs_b(spark, d), fx.obs_c(spark, d), "ck")
    return tidy(m.select("ck", *[e.alias(n) for n, e in agg.channel_labels("a_label", "a_n_obs", "b_label", "b_n_obs").items()]))


@query("a20_dedupe_first", with_views("docs", "select canon_key, min(doc_id) as doc_id, arg_min(source, doc_id) as source from docs group by 1"))
def a20(spark, d):
    return con.dedupe_first(fx.docs(spark, d).select("canon_key", "doc_id", "source"), "canon_key", "doc_id").select("canon_key", "doc_id", "source")


@query("a21_agg_where", rounded(with_views("obs_a obs_b obs_c", f"""{MERGED} select count(*) as n, avg(mean_value) filter (a_label = 1) as mean_pos,
    avg(mean_value) filter (a_label = 0) as mean_neg, count(mean_value) filter (a_label = 1) as n_pos, count(mean_value) filter (a_label = 0) as n_neg
    from merged where a_label <> b_label"""), "mean_pos mean_neg"))
def a21(spark, d):
    return tidy(agg.agg_where(_merged(spark, d), "a_label <> b_label", "mean_value", "a_label"))


# ---- sets, unions, top-k ---------------------------------------------------

@query("u1_union_distinct_limit", "select k from (select l_orderkey as k from lineitem where l_quantity > 49 union select o_orderkey from orders where o_totalprice > 450000) order by k limit 80")
def u1(spark, d):
    a = fx.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("k"))
    b = fx.table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("k"))
    return a.union(b).distinct().orderBy("k").limit(80)


@query("u2_set_operations", with_views("obs_a obs_b", """select 'both' as op, count(*) as n from (select ck from obs_a intersect select ck from obs_b)
    union all select 'either', count(*) from (select ck from obs_a union select ck from obs_b)
    union all select 'only_a', count(*) from (select ck from obs_a except select ck from obs_b)"""))
def u2(spark, d):
    a, b = fx.obs_a(spark, d).select("ck"), fx.obs_b(spark, d).select("ck")
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "only_a": a.distinct().join(b, "ck", "left_anti")}
    return con.row_counts(parts).select(F.col("source").alias("op"), F.col("n_rows").alias("n"))


@query("u3_row_concatenation", with_views("obs_a obs_b", "select 'a' as channel, ck, label from obs_a union all select 'b', ck, label from obs_b"))
def u3(spark, d):
    a = fx.obs_a(spark, d).select(F.lit("a").alias("channel"), "ck", "label")
    return a.unionByName(fx.obs_b(spark, d).select(F.lit("b").alias("channel"), "ck", "label"))


@query("t1_top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def t1(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("t2_sort", with_views("obs_a", f"{REFS} select ref, count(*) as n_items from r group by 1 order by n_items desc, ref"))
def t2(spark, d):
    return agg.crosstab(joins.item_refs(fx.obs_a(spark, d), "ck"), ["ref"]).withColumnRenamed("n", "n_items").orderBy(F.desc("n_items"), "ref")


# ---- scalar functions ------------------------------------------------------

@query("f1_strings", """select doc_id, trim(source, ' ') as stripped, array_to_string(string_split(source, 'c'), '|') as rejoined, replace(source, 'src', 'R') as replaced,
    contains(text, 'the') as has_the, starts_with(text, 'T') as starts_t, substr(text, 1, 12) as head,
    array_to_string(regexp_extract_all(source, '[0-9]'), ',') as digits, regexp_extract(source, '[0-9]+') as number,
    regexp_matches(source, '^(?:src1|src2)$') as member from documents""")
def f1(spark, d):
    s, t = F.col("source"), F.col("text")
    return fx.table(spark, d, "documents").select(
        "doc_id", F.trim(s).alias("stripped"), F.array_join(F.split(s, "c"), "|").alias("rejoined"),
        F.replace(s, F.lit("src"), F.lit("R")).alias("replaced"), F.contains(t, F.lit("the")).alias("has_the"),
        F.startswith(t, F.lit("T")).alias("starts_t"), F.substring(t, 1, 12).alias("head"),
        F.array_join(F.regexp_extract_all(s, F.lit("[0-9]"), F.lit(0)), ",").alias("digits"),
        F.regexp_extract(s, "[0-9]+", 0).alias("number"), s.rlike("^(?:src1|src2)$").alias("member"))


X = "(l_discount - 0.05::double) * 100"


@query("f2_math", rounded(f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 1 / (1 + exp(-greatest(least({X}, 30), -30))) as sigmoid,
    ln(greatest(least(l_discount, 1 - 1e-6::double), 1e-6::double) / (1 - greatest(least(l_discount, 1 - 1e-6::double), 1e-6::double))) as logit,
    greatest(least({X}, 2.0::double), -2.0::double) as clipped, sqrt(l_quantity) as root, sign(round({X}, 6))::double as sgn, abs({X}) as size from lineitem""",
    "sigmoid logit clipped root sgn size"))
def f2(spark, d):
    x = (F.col("l_discount") - 0.05) * 100.0
    return tidy(fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", c.sigmoid(x).alias("sigmoid"),
        c.logit("l_discount").alias("logit"), c.clip(x, -2.0, 2.0).alias("clipped"), F.sqrt("l_quantity").alias("root"),
        F.signum(F.round(x, 6)).alias("sgn"), F.abs(x).alias("size")))


@query("f3_arrays", rounded("""select o_orderkey, list_sort(v) as sorted, cast(len(list_distinct(v)) as integer) as n_distinct, list_avg(v) as mean from (
    select l_orderkey as o_orderkey, list(l_quantity) as v from lineitem group by 1)""", "mean"))
def f3(spark, d):
    text = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.concat(F.lit("n/a;"), F.array_join(F.collect_list(F.col("l_quantity").cast("string")), ";")).alias("t"))
    v = text.select("o_orderkey", c.parse_numbers("t").alias("v"))
    return tidy(v.select("o_orderkey", F.sort_array("v").alias("sorted"), F.size(F.array_distinct("v")).alias("n_distinct"), c.array_mean("v").alias("mean")))


@query("f4_json_encode", """select '{"o_orderkey":' || o_orderkey || ',"price":' ||
    case when o_orderkey % 3 = 0 then 'null' else cast(o_totalprice as varchar) end || '}' as json from orders""")
def f4(spark, d):
    df = fx.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"))
    return files.to_json_text(df)


@query("f5_set_digest", with_views("obs_a", """h as (select distinct ck, sha256(ck) as hx from obs_a),
    l as (select substr(hx, 1, 3) as b, sha256(string_agg(hx, chr(10) order by hx)) as dg, count(*) as n from h group by 1)
    select sha256(string_agg(dg, chr(10) order by b)) as digest, cast(sum(n) as bigint) as n from l"""))
def f5(spark, d):
    return con.set_digest(fx.obs_a(spark, d).select("ck").distinct(), "ck")


@query("f5_changed_texts", with_views("obs_a obs_b", """a as (select distinct ck from obs_a), b as (select distinct ck from obs_b)
    select coalesce(a.ck, b.ck) as ck, a.ck is not null as in_a, b.ck is not null as in_b from a full join b using (ck) where a.ck is null or b.ck is null"""))
def f5_changed(spark, d):
    return con.changed_texts(fx.obs_a(spark, d).select("ck").distinct(), fx.obs_b(spark, d).select("ck").distinct(), "ck")
