"""Identity of rows that may share ids or have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def row_key(key: str, text: str) -> Column:
    """Sixteen bytes that name an (id, text) pair; rows equal in both share them."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.length(body).cast("string"), body)))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
