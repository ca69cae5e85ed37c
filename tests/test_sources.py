"""Readers and writers on files with awkward content."""

import gzip
import hashlib

from concord.operators import contracts, metrics
from concord.sources import files


def test_header_names_are_trimmed_and_values_stay_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" id , value\n1,007\nx,\n")
    df = files.read_strings(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "value"] and df.first()["value"] == "007"
    assert [r["id"] for r in files.drop_non_numeric_key(df, "id").collect()] == [1]


def test_key_value_lines(spark, tmp_path):
    (tmp_path / "v.txt").write_text("cid\tvalue\n1\t0.5 high\n2  0.7\nlonely\n\n")
    rows = {r["key"]: r["value"] for r in files.read_key_value(spark, str(tmp_path / "v.txt"), "cid\tvalue").collect()}
    assert rows == {"1": "0.5 high", "2": "0.7"}


def test_xml_under_a_namespace(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        '<q:Set xmlns:q="urn:x"><q:Compound><q:Id>1</q:Id><q:InChI>A</q:InChI></q:Compound>'
        "<q:Compound><q:Id>2</q:Id></q:Compound></q:Set>")
    rows = files.read_xml(spark, str(tmp_path / "c.xml"), "Compound", "Id string, InChI string").collect()
    assert sorted((r["Id"], r["InChI"]) for r in rows) == [("1", "A"), ("2", None)]


def test_report_selects_by_fields(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"rules": [\n{"mode": "first", "n": 1},\n{"mode": "majority", "n": 2}]}')
    rows = files.read_report(spark, str(tmp_path / "r.json"), "rules", "rules array<struct<mode:string,n:int>>", mode="majority")
    assert [r["n"] for r in rows.collect()] == [2]


def test_manifest_and_prediction_folders(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(b"abc")
    rows = {r["name"]: r for r in files.file_manifest(spark, str(tmp_path / "*.bin"), ["one.bin", "two.bin"]).collect()}
    assert rows["one.bin"]["sha256"] == hashlib.sha256(b"abc").hexdigest() and not rows["two.bin"]["present"]
    df = spark.createDataFrame([(0, "A", 1, 1, 0.5), (1, "B", 2, 0, 0.25)], "view int, arm string, item_id int, gold int, pred double")
    files.write_predictions(df, str(tmp_path / "p"))
    back = files.read_predictions(spark, str(tmp_path / "p")).where("view = 1 AND arm = 'B'")
    assert "PartitionFilters: [isnotnull(view" in back._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("#", " #").replace("view ", "view")
    assert [r["item_id"] for r in back.collect()] == [2]


def test_manifest_of_large_files_reads_them_in_pieces(spark, tmp_path, monkeypatch):
    """Files over the limit are never read whole, and no byte is lost: line ends, marks, empty lines, zero bytes."""
    data = {"a": b"x\r\n\n\xff\x00" * 50, "b": b"\n" + bytes(range(256)) * 3, "c": b"\xef\xbb\xbf" + b"id,name\n" * 40,
            "d": b"\n" * 120, "e": b"\xef\xbb\xbf" + b"z" * 200, "f": bytes(300), "g": b"small\n"}
    for name, body in data.items():
        (tmp_path / f"{name}.bin").write_bytes(body)
    (tmp_path / "h.bin.gz").write_bytes(gzip.compress(bytes(range(256))))
    monkeypatch.setattr(files, "WHOLE_BYTES", 100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = {r["name"]: r for r in files.file_manifest(spark, str(tmp_path / "*"), ["a.bin", "none.bin"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not rows.pop("none.bin")["present"] and len(rows) == 8
    for name, r in rows.items():
        body = (tmp_path / name).read_bytes()
        assert (r["bytes"], r["sha256"], r["present"]) == (len(body), hashlib.sha256(body).hexdigest(), True), name
    # The binary source refuses files over its limit, whatever their memory.
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "512")
    try:
        assert len(files.file_manifest(spark, str(tmp_path / "b.bin")).collect()) == 1
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_compare_tables_tells_null_from_text(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "-"), (2, "x"), (3, "y")], "k int, v string")
    rows = {r["k"]: r for r in contracts.compare_tables(a, b, ["k"]).collect()}
    assert not rows[1]["identical"] and rows[2]["identical"] and not rows[3]["in_a"]


def test_json_turns_nan_into_null(spark):
    df = spark.createDataFrame([(1, float("nan"))], "k int, v double")
    assert files.to_json_text(df).first()["json"] == '{"k":1,"v":null}'
