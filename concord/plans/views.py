"""The fixture views written as SQL common table expressions."""

from __future__ import annotations

ORD = "row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
VIEWS = {
    "lines": f"""select *, cast(l_orderkey as varchar) as ck,
        cast(l_orderkey as varchar) || '|' || cast(l_linenumber % 2 as varchar) as fk,
        {ORD} as ord, 'S' || cast(l_suppkey as varchar) as ref from lineitem""",
    "obs_a": """select ck, fk, ord, case when l_linestatus = 'O' then 1 else 0 end as label, ref
        from lines where l_linenumber <= 3""",
    "obs_b": """select ck, fk, ord, case when l_returnflag = 'R' then 1 else 0 end as label
        from lines where l_returnflag <> 'N'""",
    "obs_c": """select ck, ord, round(l_discount - 0.05, 3) as value, ref
        from lines where l_linenumber >= 4""",
    "votes": """select ck as item, cast(l_suppkey % 5 as integer) as source,
        arg_min(case when l_linestatus = 'O' then 1 else 0 end, ord) as label from lines group by 1, 2""",
    "wide": """select *, (A + B) / 2.0::double as C from (
        select cast(user_id % 3 as integer) as view, event_id as item_id,
        case when event_type in ('purchase', 'signup') then 1 else 0 end as gold,
        value / (1.0::double + value) as A,
        cast(json_extract_string(props, '$.k') as double) / 99.0::double as B from events)""",
    "pred": """select view, item_id, gold, 'A' as arm, A as pred from wide
        union all select view, item_id, gold, 'B', B from wide
        union all select view, item_id, gold, 'C', C from wide""",
    "seeded": """select view, arm, seed, item_id, gold, greatest(least(pred +
        (cast(('0x' || substr(md5(cast(seed as varchar) || ':' || cast(item_id as varchar)), 1, 8)) as bigint)
        / 4294967296.0::double - 0.5::double) * 0.1::double, 1.0::double), 0.0::double) as pred
        from pred, (select cast(range as integer) as seed from range(4))""",
    "assay": """select id, ordinal, case when size >= 40 then '>' || cast(size as varchar)
        else cast(size as varchar) end as measure, ord from (
        select cast(p_partkey as varchar) as id, p_type as ordinal, p_size as size, 0 as ord from part
        union all select cast(p_partkey as varchar), p_type, p_size + 1, 1 from part
        where substr(md5(cast(p_partkey as varchar)), 1, 2) < '03')""",
    "docs": """select d.doc_id, d.source, d.lang, d.text,
        md5(lower(regexp_replace(trim(d.text, ' '), '[ \\t\\n\\r\\f]+', ' ', 'g'))) as canon_key,
        md5(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(d.text), '[a-z]+'))), ' '), '')) as parent_key,
        l.quality, l.toxic from documents d left join labels l using (doc_id)""",
}
NEEDS = {
    "obs_a": ["lines"], "obs_b": ["lines"], "obs_c": ["lines"], "votes": ["lines"],
    "pred": ["wide"], "seeded": ["wide", "pred"],
}


def with_views(names: str, body: str) -> str:
    """``body`` is further CTEs or a select; views it needs come first."""
    order: list[str] = []
    for name in names.split():
        for need in [*NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in order)
    body = body.strip()
    joint = ",\n" if not body.lower().startswith("select") else "\n"
    return f"with {ctes}{joint}{body}"
