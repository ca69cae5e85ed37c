"""Hard negatives against brute force, with nulls, ties, repeats, copies and clashing columns."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import negatives
from concord.session import ship

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def brute(rows, is_anchor, positives=5, kept=3):
    one = {}
    for d, v, y in rows:
        if d is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (y, [math.floor(256 * float(np.float32(x))) for x in v])
            one[d] = min(one.get(d, row), row)
    sizes = defaultdict(int)
    for _, v in one.values():
        sizes[len(v)] += 1
    usual = min(sizes, key=lambda n: (-sizes[n], n), default=0)
    one = {d: r for d, r in one.items() if len(r[1]) == usual}
    out = []
    for a in filter(is_anchor, one):
        score = {d: sum(map(int.__mul__, one[a][1], v)) for d, (_, v) in one.items()}
        first = lambda ids: sorted(ids, key=lambda d: (-score[d], d))
        for p in first(d for d in one if d != a and one[d][0] == one[a][0])[:positives]:
            inside = [d for d in one if one[d][0] != one[a][0] and 50 * score[p] <= 100 * score[d] <= 95 * score[p]]
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(first(inside)[:kept])]
    return sorted(out)


def vectors(draw, n, dim, skew):
    """Vectors around few centres; ``skew`` lets the first coordinates hold most of them."""
    scale = np.array([skew ** -k for k in range(dim)])
    centres = draw.standard_normal((5, dim)) * scale
    return centres[draw.integers(0, 5, n)] + 0.2 * draw.standard_normal((n, dim)) * scale


def table(draw, n, dim, skew):
    x = vectors(draw, n, dim, skew)
    return [(i, [float(v) for v in x[i]], int(draw.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"bucket": 16, "chunk": 4, "sample": 30}, {"bucket": 300, "sample": 1}])
@pytest.mark.parametrize("skew", [1.0, 2.5])
def test_hard_negatives(spark, settings, skew):
    draw = np.random.default_rng(7)
    rows = table(draw, 250, 8, skew)
    rows += [(300 + i, rows[5][1], i % 2) for i in range(40)]  # copies of one vector under two labels
    rows += [(400, None, 1), (401, rows[1][1], None), (None, rows[1][1], 1), (402, [None] * 8, 1), (403, [math.nan] + [0.0] * 7, 1),
             (404, [math.inf] + [0.0] * 7, 1), (405, [1.0, 2.0], 1), (410, [0.0] * 8, 0), (10, rows[3][1], 0), (10, rows[3][1], 0),
             (20, rows[20][1], rows[20][2])]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "v", "slots", "slot", "chunk", "part", "score", "rank", "anchor", "first", "length"):
        df = df.withColumn(name, F.lit(7))
    found = negatives.whole_numbers(df.repartition(3), "vec_id", "embedding", "label")
    got = negatives.mine(found, F.col("id") % 10 == 0, **settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda d: d % 10 == 0)
    assert len(want) > 50 and sorted(tuple(r) for r in got.collect()) == want


def test_no_rows_no_anchors_and_too_large(spark):
    empty = spark.createDataFrame([], SCHEMA)
    anchor = F.col("id") % 10 == 0
    assert negatives.mine(negatives.whole_numbers(empty, "vec_id", "embedding", "label"), anchor).count() == 0
    for rows in ([(1, [1.0], 1)], [(10, [1.0], 1)], [(10, [], 1), (11, [], 1)]):
        some = negatives.whole_numbers(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label")
        assert negatives.mine(some, anchor).count() == 0
    large = negatives.whole_numbers(spark.createDataFrame([(10, [1e30], 1)], SCHEMA), "vec_id", "embedding", "label")
    with pytest.raises(ValueError):
        negatives.mine(large, anchor)


@pytest.mark.parametrize("size", [1, 2_000_000])
def test_coordinate_ranges_lose_nothing_and_leave_out_much(size):
    draw = np.random.default_rng(3)
    x = np.floor(256 * size * vectors(draw, 1500, 16, 2.0)).astype(np.int64)
    order = np.argsort(-(x.astype(float) ** 2).sum(axis=1))
    looked = rows = 0
    q = x[::25]
    need = np.sort(q @ x.T, axis=1)[:, -20]
    found = set()
    for at in range(0, len(x), 300):
        ids = np.sort(order[at:at + 300])
        b = negatives.Bucket(0, ids, x[ids])
        for a, r, s in b.candidates(q, need):
            assert (s == (q[a] * b.x[r]).sum(axis=1)).all()
            found |= set(zip(a.tolist(), b.ids[r].tolist()))
        first, last, _ = b._ranges(q, np.sqrt((q.astype(float) ** 2).sum(axis=1)),
                                   np.clip(need / (np.linalg.norm(q.astype(float), axis=1) * b.longest), None, 1))
        looked += (last - first).min(axis=1).sum()
        rows += len(q) * len(ids)
    full = q @ x.T
    assert found == set(zip(*(c.tolist() for c in np.nonzero(full >= need[:, None]))))
    assert looked < rows / 3


def test_odd_arguments_of_tool_calls_end_in_a_status(spark):
    from concord.llm import toolcalls

    schemas = {"t": {"properties": {"a": {"type": ["string", "null"], "pattern": "^x"}, "b": {"type": "array", "items": {
        "type": "object", "properties": {"n": {"type": "integer", "minimum": 2}}, "required": ["n"], "additionalProperties": False}},
        "c": {"type": "null"}, "d": {"enum": [1, "two", None]}}}}
    cases = [('{"n":1e999}', ["not JSON"]), ("[" * 100_000, ["not JSON"]), ('{"a":' * 5000 + "1" + "}" * 5000, None), ("NaN", ["not JSON"]),
             ('{"a":"x\\ud800"}', []), ('{"a":null,"c":null}', []), ('{"a":3}', ["a: not string or null"]), ('{"a":"y"}', ["a: no match"]),
             ('{"b":[{"n":2.0},{"n":1},{"m":1}]}', ["b[1].n: out of range", "b[2].n: missing", "b[2].m: unknown"]),
             ('{"d":1.0}', []), ('{"d":true}', ["d: not a choice"]), ('{"d":null}', []), ('"\\ud800"', ["not an object"]), (None, ["not an object"])]
    calls = spark.createDataFrame([(1, f"c{i}", i, "t", text, []) for i, (text, _) in enumerate(cases)],
                                  "conv_id long, call_id string, turn long, name string, arguments string, refs array<string>")
    results = spark.createDataFrame([(1, f"c{i}", i, "r") for i in range(len(cases))], "conv_id long, call_id string, turn long, content string")
    got = {r.call_id: r for r in toolcalls.link(calls, results, schemas).collect()}
    for i, (_, want) in enumerate(cases):
        assert want is None or got[f"c{i}"].errors == want, cases[i][0][:30]
        assert got[f"c{i}"].status == ("ok" if not got[f"c{i}"].errors else "invalid")
    assert toolcalls.canonical({"b": 1.0, "a": [2.5, 1e20, True]}) == toolcalls.canonical({"a": [2.5, 1e20, True], "b": 1}) == '{"a":[2.5,1e+20,true],"b":1}'
