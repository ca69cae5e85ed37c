"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Publish: doubles rounded, every other type as it is."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            # Adding zero turns a rounded -0.0 into 0.0.
            out.append((F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            out.append(F.transform(F.col(f.name), lambda x: F.round(x, digits) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def rounded(sql: str, doubles: str, digits: int = 6) -> str:
    """Round the named double columns of a query's result."""
    body = ", ".join(f"round({c}, {digits}) + 0.0::double as {c}" for c in doubles.split())
    return f"select * replace ({body}) from ({sql}) published"
