"""Reading and writing the package's text, XML, JSON and binary inputs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Files up to this size are read whole, larger ones line by line.
WHOLE_BYTES = 64 << 20
#: Endings that Spark's text reader takes as compressed.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")
#: More bytes than any file has.
ALL_BYTES = 1 << 60
#: Left out by the text reader at the beginning of a file.
MARK = b"\xef\xbb\xbf"


def read_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited text with every column as a string and trimmed header names."""
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep, multiLine=False)
    return df.toDF(*[c.strip() for c in df.columns])


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Records of an XML file. With namespaces ignored the tag carries no prefix."""
    if ":" in row_tag:
        raise ValueError("give the row tag without its namespace prefix")
    return (
        spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(path)
    )


def read_key_value(spark: SparkSession, path: str, header: str) -> DataFrame:
    """Lines split at the first tab, else at white space; short lines drop out.

    The header is recognised by its text, since a split of a large file knows
    no first line.
    """
    line = F.col("value")
    parts = F.when(F.contains(line, F.lit("\t")), F.split(line, "\t", 2)).otherwise(F.split(F.trim(line), "\\s+"))
    return (
        spark.read.text(path).where(F.trim(line) != header.strip())
        .select(parts.alias("p")).where(F.size("p") >= 2)
        .select(F.trim(F.col("p")[0]).alias("key"), F.trim(F.col("p")[1]).alias("value"))
    )


def read_report(spark: SparkSession, path: str, array: str, schema: T.StructType | str,
                multi_line: bool = True, **match) -> DataFrame:
    """Entries of JSON reports' arrays whose named fields equal the given values.

    A report is one document per file, or with ``multi_line=False`` one per line.
    """
    df = spark.read.schema(schema).json(path, multiLine=multi_line)
    rows = df.select(F.explode(array).alias("r")).select("r.*")
    for name, value in match.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def drop_non_numeric_key(df: DataFrame, key: str) -> DataFrame:
    """Leave out rows (metadata lines) whose key is not a whole number."""
    return df.withColumn(key, F.trim(key).try_cast("bigint")).where(F.col(key).isNotNull())


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
    """Parquet by default; csv and json turn arrays into delimited text or keep them."""
    if fmt == "csv":
        df = df.select(*[
            F.array_join(F.col(f.name).cast("array<string>"), "|").alias(f.name)
            if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in df.schema.fields
        ])
    writer = df.write.mode("errorifexists")
    if by:
        writer = writer.partitionBy(*by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_predictions(df: DataFrame, path: str) -> None:
    """Store predictions so that a view and arm is one folder a reader can prune to."""
    write_table(df.repartition("view", "arm"), path, "parquet", ["view", "arm"])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def file_manifest(spark: SparkSession, glob: str, expected: Sequence[str] = ()) -> DataFrame:
    """Name, presence, size and SHA-256 of files; expected names may be missing.

    A file is one task, which holds a small file whole and of a large one some
    lines at a time. Compressed files must stay below the binary source's 2 GiB.
    """
    files = spark.read.format("binaryFile").load(glob)
    large = [(r["path"], r["length"]) for r in files.where(F.col("length") > WHOLE_BYTES).select("path", "length").collect()]
    whole = [files.where(F.col("length") <= WHOLE_BYTES)]
    packed = [path for path, _ in large if path.endswith(PACKED)]
    if packed:
        whole.append(spark.read.format("binaryFile").load(packed))
    found = [df.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"),
    ) for df in whole]
    found = reduce(DataFrame.unionByName, found + [_digest(spark, *f) for f in large if f[0] not in packed])
    if not expected:
        return found.withColumn("present", F.lit(True))
    names = spark.createDataFrame([(e,) for e in expected], "name string")
    return names.join(found, "name", "full_outer").withColumn("present", F.col("sha256").isNotNull())


def _digest(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(name, bytes, sha256) of one file, whose bytes one task sees in their order as lines."""
    # A session of its own, in which no file is split.
    own = spark.newSession()
    for key, value in (("maxPartitionBytes", ALL_BYTES), ("openCostInBytes", ALL_BYTES), ("minPartitionNum", 1)):
        own.conf.set(f"spark.sql.files.{key}", value)
    lines = own.read.text(path, lineSep="\n").select(F.col("value").cast("binary").alias("value"))
    name = path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whether a mark was left out, and a last line end, shows in the number of bytes.
        made, size = [hashlib.sha256(), hashlib.sha256(MARK)], 0
        for batch in batches:
            if batch.num_rows:
                body = b"\n" * (size > 0) + b"\n".join(batch["value"].to_pylist())
                # The first line may be empty, so the place is counted from one.
                size = max(size, 1) + len(body)
                for h in made:
                    h.update(body)
        missing = length - (size - 1)
        if missing not in (0, 1, 1 + len(MARK), len(MARK)):
            raise ValueError(f"{name}: {size - 1} of {length} bytes were read")
        h = made[missing >= len(MARK)]
        h.update(b"\n" * (missing % len(MARK)))
        yield pa.RecordBatch.from_pydict({"name": [name], "bytes": [length], "sha256": [h.hexdigest()]})

    return lines.mapInArrow(run, "name string, bytes long, sha256 string")


def to_json_text(df: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """One JSON document per row; NaN becomes null."""
    cols = [
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("json"))
