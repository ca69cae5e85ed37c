"""Column expressions: labels, coercion, flags, bins and numeric helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Col = Column | str


def _c(value: Col) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---- labels and coercion ---------------------------------------------------

def binary_label(value: Col, positive: str) -> Column:
    """1 when the trimmed text equals ``positive``, else 0 (also for null)."""
    return F.coalesce((F.trim(_c(value)) == positive).cast("int"), F.lit(0))


def parse_label(value: Col) -> Column:
    """0.0 or 1.0 from its accepted spellings, null from anything else."""
    text = F.trim(_c(value).cast("string"))
    return F.when(text.isin("0", "1", "0.0", "1.0"), text.try_cast("double"))


def to_double(value: Col) -> Column:
    return F.trim(_c(value).cast("string")).try_cast("double")


def blank_to_null(value: Col) -> Column:
    return F.nullif(F.trim(_c(value)), F.lit(""))


def parse_censored(value: Col) -> tuple[Column, Column]:
    """(number, flag) from text such as ``12`` or ``>10``."""
    text = F.trim(_c(value))
    return F.trim(F.replace(text, F.lit(">"), F.lit(""))).try_cast("double"), F.startswith(text, F.lit(">"))


def label_variants(ordinal: Col, value: Col, positive: Sequence[str], boundary: float) -> dict[str, Column]:
    """Three binary rules that differ only for rows sitting on the boundary."""
    y = F.coalesce(_c(ordinal).isin(*positive).cast("int"), F.lit(0))
    at = F.coalesce(_c(value) == F.lit(float(boundary)), F.lit(False))
    return {
        "y": y,
        "y_low": F.when(at, F.lit(0)).otherwise(y),
        "y_high": F.when(at, F.lit(1)).otherwise(y),
    }


# ---- flags, ranges, bins ---------------------------------------------------

def labels_differ(a: Col, b: Col) -> Column:
    """True only when both labels are known and unequal."""
    return F.coalesce(_c(a) != _c(b), F.lit(False))


def sign_contradicts(value: Col, label: Col) -> Column:
    """A positive value beside label 0, or a negative one beside label 1."""
    v, y = _c(value), _c(label)
    return F.coalesce(((v > 0) & (y == 0)) | ((v < 0) & (y == 1)), F.lit(False))


def conflict_status(a: Col, b: Col) -> Column:
    a, b = _c(a), _c(b)
    return (
        F.when(a.isNull() | b.isNull(), F.lit("missing"))
        .when(a != b, F.lit("conflict"))
        .otherwise(F.lit("nonconflict"))
    )


def range_check(value: Col, low: Col, high: Col) -> dict[str, Column]:
    v, lo, hi = _c(value), _c(low), _c(high)
    mid = (lo + hi) / F.lit(2.0)
    return {"mid": mid, "abs_diff": F.abs(v - mid), "within": v.between(lo, hi).cast("int")}


def bucketize(value: Col, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins over ``edges``; the last label takes everything above."""
    if len(labels) != len(edges):
        raise ValueError("one label per lower edge is needed")
    v = _c(value)
    out = F.when(v <= F.lit(float(edges[0])), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(v <= F.lit(float(upper)), F.lit(label))
    return out.when(v > F.lit(float(edges[-1])), F.lit(labels[-1]))


# ---- numeric helpers -------------------------------------------------------

def clip(value: Col, low: float, high: float) -> Column:
    return F.greatest(F.least(_c(value), F.lit(float(high))), F.lit(float(low)))


def sigmoid(value: Col, bound: float = 30.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(value, -bound, bound)))


def logit(p: Col, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def parse_numbers(value: Col, sep: str = ";") -> Column:
    """Doubles from delimited text; pieces that are not numbers are left out."""
    pieces = F.transform(F.split(_c(value), sep), lambda x: F.trim(x).try_cast("double"))
    return F.coalesce(F.filter(pieces, lambda x: x.isNotNull()), F.array().cast("array<double>"))


def array_mean(values: Col) -> Column:
    v = _c(values)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(v) > 0, total / F.size(v).cast("double"))


# ---- repeatable draws ------------------------------------------------------

def hash_hex(*parts: Col | int) -> Column:
    cols = [F.lit(str(p)) if isinstance(p, int) else _c(p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols).cast("binary"))


def hex_int(hexed: Column, chunk: int | Column = 0) -> Column:
    """The ``chunk``-th run of 8 hex digits as a number below 2**32."""
    start = F.lit(1 + 8 * chunk) if isinstance(chunk, int) else (chunk * 8 + 1)
    return F.conv(F.substring(hexed, start, F.lit(8)), 16, 10).cast("bigint")


def hash_uniform(*parts: Col | int) -> Column:
    return hex_int(hash_hex(*parts)) / F.lit(4294967296.0)
