"""Archive, nearest neighbours, tool calls and the pipeline, with their odd cases."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import archive, forest, toolcalls
from concord.llm.toolcalls_query import SCHEMAS, derived
from concord.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# archive -------------------------------------------------------------------------------------------------------


def round_trip(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn(
        "digest", F.lit("x"))
    folder = archive.new_folder(spark)
    archive.write_archive(pages, folder)
    return folder, archive.read_records(spark, folder)


def test_archive_round_trip(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (7, None, big), (3, "http://a/\r\nX: y", other), (4, "u", "b" * 999),
            (5, "u", "b" * 999), (6, "u", None), (8, "u", ""), (None, "u", other), (None, "u", "c" * 2000), (9, "v", "d" * 3000),
            (9, "v", "d" * 3000), (10, "w", "e\r\n\r\nWARC/1.1" * 50000)]
    folder, records = round_trip(spark, rows)
    got = archive.parse_records(records).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    by = {(r.page_id, r.payload_bytes): r for r in got}
    for page, _, html in rows:
        body = (html or "").encode()
        r = by[(page, len(body))]
        assert r.payload_digest == hashlib.sha1(body).hexdigest()
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in got}
    assert kinds[(7, 1200)] == ("response", None) and kinds[(1, 1200)] == kinds[(2, 1200)] == ("revisit", 7)
    assert kinds[(3, 1000)] == ("response", None) and kinds[(None, 1000)] == ("revisit", 3)
    assert kinds[(4, 999)] == kinds[(5, 999)] == kinds[(6, 0)] == kinds[(8, 0)] == ("response", None)
    assert kinds[(None, 2000)] == kinds[(9, 3000)] == ("response", None)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({(h or "") for _, _, h in rows})
    for r in records.collect():
        head = bytes(r.head, "utf-8")
        assert head.startswith(b"WARC/1.1\r\n") and head.endswith(b"\r\n\r\n") and b"\nX: y" not in head
        body = b"" if "WARC-Type: revisit" in r.head else bytes(r.payload)
        assert bytes(r.record) == head + body + b"\r\n\r\n"
        assert f"Content-Length: {len(body)}\r\n" in r.head


def test_a_damaged_archive_fails_the_query(spark):
    folder, records = round_trip(spark, [(1, "u", "a" * 1500), (2, "u", "a" * 1500), (3, "v", "b" * 20)])
    assert len(archive.proven(archive.parse_records(records)).collect()) == 3
    for damaged in (records.withColumn("payload", F.expr("cast(concat(cast(payload as string), 'x') as binary)")),
                    records.withColumn("record", F.substring("record", 1, 10)), records.withColumn("sound", F.lit(False))):
        with pytest.raises(Exception, match="not verified"):
            archive.proven(archive.parse_records(damaged)).collect()


def test_archive_of_no_rows(spark):
    assert archive.parse_records(round_trip(spark, [])[1]).count() == 0


# nearest neighbours --------------------------------------------------------------------------------------------


def brute_nearest(rows, k):
    x = np.array([v for _, v in rows], dtype=float)
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_nearest_reach_the_recall_of_brute_force(spark):
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.standard_normal((1500, 16)), np.repeat(draw.standard_normal((4, 16)), 50, axis=0),
                        draw.standard_normal((300, 16)) * 5]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(10020, None), (10040, [0.0] * 16), (10060, [float("nan")] * 16), (10080, [1.0, None] * 8), (10100, [float("inf")] * 16),
           (10120, [1.0] * 3), (None, rows[0][1]), (20, rows[20][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("ids", F.lit(1)).withColumn("v", F.lit(2))
    got = forest.nearest(df, F.col("id") % 20 == 0, k=20, leaf=64).collect()
    want = brute_nearest([(i, np.array(v, dtype=np.float32)) for i, v in rows], 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert set(found) == set(want)
    hits = 0
    for q, mine in found.items():
        mine.sort()
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(a[2] > b[2] - 1e-12 for a, b in zip(mine, mine[1:]))
        assert all(abs(s - float(np.dot(x[i].astype(float), x[q].astype(float)))) < 1e-9 for _, i, s in mine)
        hits += len({m[1] for m in mine} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_copies_of_a_vector_are_ranked_by_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.5, 0.5])]
    got = forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 40, k=20).orderBy("rank").collect()
    assert [r.id for r in got] == list(range(20)) and {r.score for r in got} == {1.0}


def test_few_and_no_candidates(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], schema)
    got = forest.nearest(few, F.col("id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.id, r.score) for r in got] == [(0, 1, 1, 0.0), (0, 2, 2, -1.0)]
    assert forest.nearest(few.limit(0), F.col("id") % 20 == 0).count() == 0
    assert forest.nearest(few.where("vec_id = 0"), F.col("id") % 20 == 0).count() == 0


# tool calls ----------------------------------------------------------------------------------------------------

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, refs array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def test_calls_are_linked_ordered_and_checked(spark):
    ok = '{"query":"é", "n":3}'
    calls = [(1, "a", 1, "search", ok, []), (1, "b", 2, "search", ok, ["a"]), (1, "c", 3, "search", ok, ["b", "a", "a"]),
             (1, "d", 4, "search", '{"n":300,"query":"x"}', None), (1, "e", 5, "nothing", ok, []), (1, "f", 6, "search", "no json", []),
             (1, "g", 7, "search", None, []), (1, "h", 8, "write", '{"n":true,"z":1}', ["zz"]), (1, "x", 9, "search", ok, ["y"]),
             (1, "y", 10, "search", ok, ["x"]), (1, "w", 11, "search", ok, ["y"]), (1, "s", 12, "search", ok, ["s"]),
             (2, "a", 1, "search", ok, []), (2, "a", 0, "write", '{"n":1}', []), (2, "b", 1, "search", ok, ["a"]),
             (None, "q", 1, "search", ok, []), (3, None, 1, "search", ok, []), (4, "nan", 1, "search", '{"n":NaN,"query":""}', [])]
    results = [(1, k, 20, f"r{k}") for k in "abcdefghxyws"] + [(2, "a", 5, "late"), (2, "a", 4, None), (5, "lost", 1, "r"), (None, "a", 1, "r")]
    df = spark.createDataFrame(calls, CALLS).withColumn("n", F.lit(1)).withColumn("level", F.lit("x"))
    out = {(r.conv_id, r.call_id): r for r in toolcalls.link(df, spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}
    status = {k: r.status for k, r in out.items()}
    assert [status[(1, k)] for k in "abcdefghxyws"] == ["ok"] * 3 + ["invalid"] * 5 + ["cyclic"] * 4
    assert [out[(1, k)].level for k in "abc"] == [0, 1, 2] and out[(1, "x")].level is None
    assert status[(2, "a")] == "ok" and out[(2, "a")].copies == 2 and status[(2, "b")] == "unanswered" and out[(2, "b")].level == 1
    assert status[(5, "lost")] == "orphan" and status[(4, "nan")] == "invalid" and len(out) == 16
    assert out[(1, "h")].errors == ["n: not integer", "z: unknown", "refs: unknown zz"]
    assert out[(1, "a")].json == '{"arguments":{"n":3,"query":"é"},"id":"a","name":"search","result":"ra","status":"ok"}'
    assert json.loads(out[(2, "a")].json)["result"] is None


def test_calls_of_no_rows(spark):
    got = toolcalls.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS)
    assert got.count() == 0


def test_every_assistant_turn_is_a_call(spark, sf):
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = spark.createDataFrame([(None, 1, "assistant", "x"), (9000, None, "assistant", "x"), (9001, 1, "assistant", None),
                                 (9001, 1, "assistant", None), (9001, 2, "user", None), (9001, 1, None, "x")],
                                "conv_id long, turn long, role string, text string")
    talks = talks.unionByName(odd)
    got = toolcalls.link(*derived(talks), SCHEMAS).where("status <> 'orphan'")
    want = talks.where("role = 'assistant' AND conv_id IS NOT NULL").select(
        "conv_id", F.concat_ws(":", "conv_id", "turn")).distinct().count()
    assert got.count() == want and got.select("conv_id", "call_id").distinct().count() == want
    assert got.where("conv_id = 9001").first().copies == 1


# pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    draw = random.Random(11)

    def prose(n):
        return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 7))) for _ in range(n))

    passage = "\n".join(prose(10) for _ in range(8))
    item = prose(30)
    docs, labels = [], []
    for i in range(120):
        bad = i % 4 == 0
        w = prose(60).split()
        for _ in range(3 * bad):
            w[draw.randrange(60)] = draw.choice(["grumblor", "snarfelt"])
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(bad)))
    near = prose(80).split()
    docs += [(200, " ".join(near)), (201, " ".join(near[:-2] + ["x", "y"])), (202, " ".join(near)), (202, " ".join(near))]
    docs += [(210, f"{prose(5)}\n{passage}\n{prose(6)}"), (211, f"{prose(5)}\n{prose(4)}\n{passage}\n{prose(6)}"), (212, passage)]
    docs += [(220, f"{prose(20)} {item} {prose(20)}"), (230, None), (231, ""), (None, prose(30)), (None, "grumblor snarfelt grumblor"),
             (240, prose(20)), (240, prose(25))]
    full = [(d, t, "en", "s", len(t) if t else 0, 1, "z") for d, t in docs]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_removed int, row string")
    folder = archive.new_folder(spark)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    df.write.parquet(f"{folder}/documents.parquet")

    def ids(frame):
        return sorted((r.doc_id for r in frame.select("doc_id").collect()), key=lambda d: -1 if d is None else d)

    kept, frame = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        frame.write.parquet(f"{folder}/{name}")
        frame = spark.read.parquet(f"{folder}/{name}")
        assert frame.columns == df.columns
        kept[name] = ids(frame)
    clean = sorted([d for d, _ in docs if d is not None and not (d < 120 and d % 4 == 0)])
    assert kept["toxicity"] == [None] + clean
    # The copies of 200 are one long line each and go with their only line, as does the passage alone.
    assert kept["line_dedup"] == [None] + [d for d in clean if d not in (202, 212)]
    assert kept["near_duplicates"] == [None] + [d for d in clean if d not in (201, 202, 212)][:-1]
    assert kept["decontamination"] == [d for d in kept["near_duplicates"] if d != 220]
    texts = {r.doc_id: r for r in spark.read.parquet(f"{folder}/line_dedup").collect()}
    assert passage in texts[210].text and texts[211].text.count("\n") == 2 and texts[211].n_chars == len(texts[211].text)
    assert texts[230].text is None and texts[231].text == ""
    out = pipeline.run(spark, folder)
    assert sorted({r.doc_id for r in out.select("doc_id").collect() if r.doc_id is not None}) == sorted(set(kept["decontamination"][1:]))


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    import corpus_pipeline as pipeline

    draw = random.Random(12)

    def prose(n):
        return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 7))) for _ in range(n))

    shared, own, other = prose(40), prose(40), prose(40)
    rows = [(1, shared), (5, shared), (5, own), (6, None), (6, other), (6, other), (None, shared), (7, None), (8, "")]
    got = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, shared), (5, own), (6, other), (None, shared), (7, None), (8, "")} and len(got) == 6


def test_pipeline_of_no_documents(spark, sf):
    import corpus_pipeline as pipeline

    frame = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, frame, sf)
        assert out.count() == 0
