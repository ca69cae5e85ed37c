"""SimHash components and ranked search against brute force, with nulls, empty and very long texts, repeats and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from concord.llm import lexical, simhash
from concord.session import ship

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def clashing(df):
    for name in ("id", "fp", "key", "low", "n", "terms", "data", "item", "score", "rank", "component_id"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(7))
    return df


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(draw, n, size=400):
    return " ".join(f"w{draw.randrange(size)}" for _ in range(n))


# SimHash -------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints_are_the_defined_ones():
    draw = random.Random(1)
    texts = ["", " \t\n", "a", "A b", "É É x\x1cy \x85 z", "x " * 70000, "a b c a b c a b c"]
    texts += [prose(draw, draw.randint(1, 60)) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def close(a, b):
    return (a ^ b).bit_count() <= 3


def around(draw, centres, each, most):
    out = set()
    for _ in range(centres):
        base = draw.getrandbits(64)
        for _ in range(each):
            x = base
            for _ in range(draw.randint(0, most)):
                x ^= 1 << draw.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_index_loses_no_link(spark, hot):
    draw = random.Random(2)
    found = around(draw, 12, 25, 7)
    # One half shared by many, with the other half spread and in clusters.
    half = draw.getrandbits(32)
    for x in around(draw, 6, 12, 6):
        found.append(half << 32 | x & 0xFFFFFFFF)
        found.append((half ^ 1 << draw.randrange(32)) << 32 | x & 0xFFFFFFFF)
    found = sorted(set(found))
    signed = {x: x - (1 << 64) if x >> 63 else x for x in found}
    links = simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), hot).collect()
    back = {v: k for k, v in signed.items()}
    pairs = {(back[r.a], back[r.b]) for r in links}
    got = brute_components(found, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert got == brute_components(found, close)


def test_dense_groups_by_differences_equal_pairs(monkeypatch):
    import numpy as np

    draw = random.Random(3)
    for n, bits in ((3000, 18), (150, 18), (90, 12)):
        own = (np.array(sorted({draw.getrandbits(bits) for _ in range(n)}), np.uint64) << np.uint64(20)) | np.uint64(9)
        monkeypatch.setattr(simhash, "PAIRS", 10**6)
        want = simhash.group_roots(own)
        monkeypatch.setattr(simhash, "PAIRS", 8)
        assert (simhash.group_roots(own) == want).all()


def test_simhash_components(spark):
    draw = random.Random(4)
    rows = []
    for d in range(0, 60, 6):
        words = prose(draw, 300).split()
        for k in range(5):
            own = list(words)
            for _ in range(k):
                own[draw.randrange(300)] = "edited"
            rows.append((d + k, " ".join(own)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "two words"), (104, "Two  Words"), (None, "two words"), (None, "alone in the text"),
             (105, "word " * 40000), (106, rows[0][1]), (106, "quite another text of its own"), (107, "quite another text of its own"),
             (3, rows[3][1]), (3, rows[3][1])]
    out = simhash.near_duplicates(clashing(spark.createDataFrame(rows, SCHEMA)))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = Counter(tuple(r) for r in out.collect())
    fp = {i: brute_fingerprint(t) for i, (_, t) in enumerate(rows)}
    part = brute_components(range(len(rows)), lambda a, b: close(fp[a], fp[b]) or (rows[a][0] is not None and rows[a][0] == rows[b][0]))
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[part[i]].append(d)
    want = Counter((d, f"{fp[i]:016x}", min(low[part[i]], default=None)) for i, (d, _) in enumerate(rows))
    assert got == want
    assert len({c for _, _, c in got}) < len(got)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


# ranked search -------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_rank(docs, items, top=10):
    found = [(d, Counter(TERM.findall(lowered(t)))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        if i is not None:
            wanted[i] |= set(TERM.findall(lowered(t)))
    out = []
    for i, own in wanted.items():
        scored = []
        for d, c in found:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in own if c[t])
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def search_case(draw):
    docs = [(d, prose(draw, draw.randint(0, 120), 300) + (" rare" * (d % 3)) * (d % 7 == 0)) for d in range(150)]
    docs += [(500, None), (501, ""), (502, "--- ;; !"), (503, docs[5][1]), (503, docs[5][1]), (None, docs[6][1]), (504, "É w1-W2_w3 ñandú 日本"),
             (505, "w1 " * 60000)]
    items = [(i, prose(draw, draw.randint(1, 30), 300)) for i in range(12)]
    items += [(20, None), (21, ""), (22, "rare É"), (23, "unseen"), (None, "w1"), (24, "w1 w2"), (24, "w3"), (24, "w3"),
              (25, " ".join(f"w{i}" for i in range(200))), (26, "日本 ñandú")]
    return docs, items


@pytest.mark.parametrize("settings", [{}, {"block": 7}, {"group_bytes": 300, "top": 3}])
def test_ranked_search(spark, settings):
    docs, items = search_case(random.Random(5))
    frame = clashing(spark.createDataFrame(docs, SCHEMA)).repartition(3)
    out = lexical.rank(frame, clashing(spark.createDataFrame(items, "item_id long, text string")), **settings)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in out.collect()) == brute_rank(docs, items, settings.get("top", 10))


def test_ranked_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], SCHEMA), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).count() == lexical.rank(docs, items.limit(0)).count() == 0
    assert lexical.rank(docs, items).count() == 1


def test_search_stops_early_and_is_exact():
    import numpy as np

    draw = np.random.default_rng(1)
    n, weight, postings = 4000, np.array([9, 7, 5, 3, 2, 1, 1, 1]), {}
    for t in range(8):
        rows = np.flatnonzero(draw.random(n) < 0.03 * (t + 1))
        postings[t] = rows, draw.integers(1, 100, len(rows))
    seen = []

    def counted(rows, *rest, real=lexical._scores):
        seen.append(len(rows))
        return real(rows, *rest)

    lexical._scores, kept = counted, lexical._scores
    try:
        got = lexical.search_block(np.arange(n), postings, weight, np.arange(8), [], 10)
    finally:
        lexical._scores = kept
    full = np.zeros(n, np.int64)
    for t, (rows, value) in postings.items():
        full[rows] += weight[t] * value
    assert got == sorted(zip((-full).tolist(), range(n)))[:10]
    assert sum(seen) < n // 4
