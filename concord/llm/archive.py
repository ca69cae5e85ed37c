"""Content-addressed WARC archive: payloads once, record headers apart, records by join.

``headers`` keeps the exact header bytes of every record and the digest of its
payload; ``payloads`` keeps the bytes of every digest once. A digest is SHA-256
together with SHA-1 and the length, all of which must agree for two payloads to
be one, and reading recomputes them from the stored bytes. Records are put
together again by a join on the digest.

Of records with one payload of at least ``least`` bytes the one with the
largest id is the response, the others revisit it. Shorter payloads are
responses all.

Defined results: a null payload is an empty one; line ends in a URL are
percent-encoded and a null URL has no header line; a null id is written as
``none`` and read back as null, and is the response only among nulls; repeated
rows give one record each, of the same type; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.session import shared_folder

END = "\r\n"
LEAST = 1000
DATE = "2020-01-01T00:00:00Z"
#: Stands for a null id where rows are dealt out and joined.
NO_PAGE = -(1 << 63)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def digest_of(payload: Column) -> Column:
    """SHA-256, SHA-1 and length of a payload, as one binary value."""
    return F.concat(F.unhex(F.sha2(payload, 256)), F.unhex(F.sha1(payload)),
                    F.octet_length(payload).cast("string").cast("binary"))


def keyed(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(body).cast("binary"), F.lit("").cast("binary"))
    return pages.select(
        F.col(key).alias("page"), F.col(url).alias("url"), payload.alias("payload"), digest_of(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"))


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html",
                  least: int = LEAST, date: str = DATE) -> None:
    """Write one record per row of ``pages`` to ``folder``/headers and ``folder``/payloads."""
    rows = keyed(pages, key, url, body)
    bare = rows.drop("payload")
    owners = bare.groupBy("digest").agg(F.max("page").alias("owner"))
    # Digest and id together spread the copies of one payload over many tasks.
    owned = owners.select("digest", F.coalesce("owner", F.lit(NO_PAGE)).alias("dealt"))
    held = rows.withColumn("dealt", F.coalesce("page", F.lit(NO_PAGE))).select("digest", "dealt", "payload").join(
        owned, ["digest", "dealt"]).dropDuplicates(["digest", "dealt"]).select("digest", "payload")
    held.write.option("compression", "zstd").parquet(f"{folder}/payloads")

    revisit = (F.col("n_bytes") >= least) & ~F.col("page").eqNullSafe(F.col("owner"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page"))),
        _line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), "").otherwise(_line("WARC-Target-URI", target)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.lower(F.hex(F.substring("digest", 33, 20))))),
        F.when(revisit, F.concat(
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _line("WARC-Refers-To", _urn(F.col("owner"))))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(END)).cast("binary")
    bare.join(owners, "digest").select("digest", head.alias("head")).write.option(
        "compression", "zstd").parquet(f"{folder}/headers")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record put together again: its header, its exact bytes, the full payload, and whether digests agree.

    A revisit's record has no block; its payload is that of the response it names.
    """
    joined = spark.read.parquet(f"{folder}/headers").join(spark.read.parquet(f"{folder}/payloads"), "digest")
    text = F.col("head").cast("string")
    block = F.when(_field(text, "Content-Length") == "0", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return joined.select(
        text.alias("head"), F.concat("head", block, F.lit(END + END).cast("binary")).alias("record"), "payload",
        (digest_of(F.col("payload")) == F.col("digest")).alias("sound"))


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def parse_records(records: DataFrame) -> DataFrame:
    """Page, payload size and digest, type and reference of records, from their headers and payloads."""
    def page(name: str) -> Column:
        return F.regexp_extract(_field(F.col("head"), name), r"<urn:page:(-?\d+)>", 1)

    return records.select(
        F.nullif(page("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        F.nullif(page("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"),
        F.octet_length("record").cast("long").alias("record_bytes"),
        (F.col("sound") & (F.concat(F.lit("sha1:"), F.sha1("payload")) == _field(F.col("head"), "WARC-Payload-Digest"))
         ).alias("verified"))


def proven(parsed: DataFrame) -> DataFrame:
    """``parsed`` without record_bytes and verified; a record that is not whole or whose digests disagree fails the query.

    The digest's value depends on both, so Spark cannot leave out what they are made from.
    """
    block = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    sound = F.col("verified") & (F.col("record_bytes") > block + 2 * len(END))
    digest = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(
        F.concat(F.lit("archive record not verified: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))))
    return parsed.withColumn("payload_digest", digest).drop("record_bytes", "verified")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
