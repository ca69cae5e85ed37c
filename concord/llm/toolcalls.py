"""Tool calls of conversations linked with their results.

Calls and results meet by a join on (conversation, call id). A call may refer
to earlier calls; its level is the length of the longest chain of references
below it (one round of joins per level), and sorting by (level, turn, call id)
is a topological order of a conversation. Arguments are checked against the tool's schema and every linked
call is serialised as canonical JSON: sorted keys, no spaces, no escapes beyond
those JSON asks for.

Conversations are never gathered: every call is a row, so a conversation with a
third of all rows is spread like any other rows.

Defined results, in the column ``status``: ``ok``; ``invalid`` (arguments that
are no JSON object or break the schema, or a tool without schema); ``cyclic``
(refers to itself, directly or through others, or to a call that does);
``unanswered``; ``orphan`` (a result without call, on level 0). The first that
holds of orphan, cyclic, invalid, unanswered counts. Of calls that share an id
the one with the smallest turn counts (then the smallest arguments), and of
results likewise; ``copies`` counts the rest. References to unknown calls are
errors of the arguments. Rows without conversation or call id take no part;
null arguments are no object and null contents stay null; numbers beyond doubles
and nesting too deep to read are no JSON, and such arguments are kept as text;
half of a surrogate pair becomes U+FFFD; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from concord.session import cut_lineage

KEYS = ["conv_id", "call_id"]


KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
#: Half of a pair that stands alone; no text can hold it.
_LONE = re.compile("[\ud800-\udfff]")


def parse(text: str | None):
    """The value of a JSON text; ValueError for what is none, numbers beyond doubles and nesting too deep to read."""
    try:
        return json.loads(text or "null", parse_constant=_no_number, parse_float=_finite)
    except RecursionError:
        raise ValueError("nested too deep") from None


def _no_number(name: str):
    raise ValueError(name)


def _finite(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _no_number(digits)


def _plain(value):
    """Numbers that are whole as whole numbers, so that equal numbers are one text."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def storable(text: str) -> str:
    """``text`` with every lone surrogate replaced by U+FFFD."""
    return _LONE.sub("\ufffd", text)


def canonical(value) -> str:
    """One text for equal values: keys in order of their code points, shortest separators, whole numbers without a point."""
    return storable(json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, KINDS.get(kind, ()))


def problems(rule: dict, value, path: str = "") -> list[str]:
    """What is wrong with a value under a schema: types (one or several), ranges, lengths, patterns, choices, fields and items."""
    kinds = rule.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    here = f"{path}: " if path else ""
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{here}not {' or '.join(kinds)}"]
    out = []
    if isinstance(value, str):
        out += [f"{here}too short"] if len(value) < rule.get("minLength", 0) else []
        out += [f"{here}too long"] if len(value) > rule.get("maxLength", len(value)) else []
        out += [f"{here}no match"] if "pattern" in rule and not re.search(rule["pattern"], value) else []
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [] if rule.get("minimum", value) <= value <= rule.get("maximum", value) else [f"{here}out of range"]
    if "enum" in rule and not any(type(v) is type(value) and v == value or _number(v) and _number(value) and v == value for v in rule["enum"]):
        out.append(f"{here}not a choice")
    if isinstance(value, list):
        out += [f"{here}too few"] if len(value) < rule.get("minItems", 0) else []
        out += [f"{here}too many"] if len(value) > rule.get("maxItems", len(value)) else []
        if isinstance(rule.get("items"), dict):
            for i, v in enumerate(value):
                out += problems(rule["items"], v, f"{path}[{i}]")
    if isinstance(value, dict):
        fields, inside = rule.get("properties", {}), f"{path}." if path else ""
        out += [f"{inside}{name}: missing" for name in sorted(rule.get("required", [])) if name not in value]
        for name in sorted(value):
            more = fields.get(name, rule.get("additionalProperties", True))
            if more is False:
                out.append(f"{inside}{name}: unknown")
            elif isinstance(more, dict):
                out += problems(more, value[name], f"{inside}{name}")
    return out


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def check_arguments(schema: dict | None, value) -> list[str]:
    """What is wrong with a call's arguments, which must be an object."""
    if schema is None:
        return ["unknown tool"]
    if not isinstance(value, dict):
        return ["not an object"]
    return problems({**schema, "type": "object"}, value)


def _first(df: DataFrame, order: list[str], rest: list[str]) -> DataFrame:
    """One row per (conversation, call id), the smallest by ``order``, and how many there were."""
    low = F.min(F.struct(*order, *rest)).alias("low")
    return df.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*KEYS).agg(
        low, F.count("*").alias("n")).select(*KEYS, *[F.col(f"low.{c}").alias(c) for c in [*order, *rest]], "n")


def levels(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every caller in ``refs`` (conv_id, call_id, ref); level null within a cycle.

    One round for each level: references to calls without open references of
    their own are closed.
    """
    known = calls.select("conv_id", F.col("call_id").alias("ref"))
    left = cut_lineage(refs.join(known, ["conv_id", "ref"], "left_semi").distinct())
    closed, level = None, 0
    while True:
        level += 1
        waiting = left.select("conv_id", F.col("call_id").alias("ref")).distinct()
        done = left.join(waiting, ["conv_id", "ref"], "left_anti").withColumn("level", F.lit(level))
        done = cut_lineage(done.select(*KEYS, "ref", "level"))
        if not done.limit(1).count():
            break
        closed = done if closed is None else closed.union(done)
        left = cut_lineage(left.join(done.select(*KEYS, "ref"), [*KEYS, "ref"], "left_anti"))
    stuck = left.select(*KEYS).distinct().withColumn("level", F.lit(None).cast("int"))
    if closed is None:
        return stuck
    return closed.groupBy(*KEYS).agg(F.max("level").alias("level")).join(
        stuck, KEYS, "left_anti").union(stuck.select(*KEYS, "level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every call with its result, level, status, errors and canonical JSON, and results without call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), refs (array of call ids).
    ``results``: conv_id, call_id, turn, content.
    """
    one = cut_lineage(_first(calls, ["turn", "arguments"], ["name", "refs"]))
    answer = _first(results, ["turn", "content"], []).withColumnsRenamed(
        {"turn": "result_turn", "n": "result_n"}).withColumn("answered", F.lit(True))
    refs = one.select(*KEYS, F.explode("refs").alias("ref"))
    unknown = refs.join(one.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"], "left_anti").groupBy(
        *KEYS).agg(F.sort_array(F.collect_set("ref")).alias("unknown"))
    depth = levels(one, refs).withColumn("linked", F.lit(True))
    joined = one.withColumn("called", F.lit(True)).join(answer, KEYS, "full").join(depth, KEYS, "left").join(
        unknown, KEYS, "left")
    joined = joined.select(
        *KEYS, "turn", "name", "arguments", "content", "result_turn", "called", "answered",
        F.when(F.col("linked"), F.col("level")).otherwise(0).alias("level"),
        (F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)) - 1 + F.greatest(F.coalesce("result_n", F.lit(1)), F.lit(1)) - 1
         ).cast("long").alias("copies"),
        F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"))
    kinds = dict(joined.dtypes)
    schema = (f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, turn {kinds['turn']}, level int, status string, "
              "errors array<string>, copies long, json string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                errors, value = [], None
                if r["called"]:
                    try:
                        value = parse(r["arguments"])
                        errors = check_arguments(schemas.get(r["name"]), value)
                        canonical(value)
                    except (ValueError, RecursionError):
                        errors = ["not JSON"]
                    errors = [storable(e) for e in errors] + [f"refs: unknown {x}" for x in r["unknown"]]
                status = ("orphan" if not r["called"] else "cyclic" if r["level"] is None else "invalid" if errors
                          else "unanswered" if not r["answered"] else "ok")
                text = canonical({
                    "id": r["call_id"], "name": r["name"], "result": r["content"], "status": status,
                    "arguments": r["arguments"] if errors[:1] == ["not JSON"] else value})
                rows.append((r["conv_id"], r["call_id"], r["turn"], r["level"], status, errors, r["copies"], text))
            out = pd.DataFrame(rows, columns=["conv_id", "call_id", "turn", "level", "status", "errors", "copies", "json"])
            for name in ("conv_id", "turn", "level"):
                out[name] = pd.array(out[name], dtype=object)
            yield out

    return joined.mapInPandas(run, schema)


def text_id(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)
