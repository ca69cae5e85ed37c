"""op5: every page written to a content-addressed archive and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm import archive
from concord.llm.registry import query, table

SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), k as (
  select page_id, octet_length(payload) as n, sha1(payload) as d from p
), o as (select d, max(page_id) as owner from k group by d)
select k.page_id, n::bigint as payload_bytes, k.d as payload_digest,
  case when n >= 1000 and k.page_id <> owner then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and k.page_id <> owner then owner end as refers_to
from k join o on k.d = o.d
"""


@query("op5_archive", SQL)
def op5_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive.new_folder(spark)
    archive.write_archive(table(spark, sf_dir, "pages"), folder)
    return archive.proven(archive.parse_records(archive.read_records(spark, folder)))
