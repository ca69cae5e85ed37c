"""Secret scan that links the parts of a credential.

Sure findings stand alone: assignments of long values to words such as
``password``, access key ids and long runs of hex digits. Weak parts (short
assigned values, account names, endpoints) are reported only where the parts
complete one another: an interval join within each text asks which other parts
lie no further than ``SCOPE`` characters away. A weak secret needs an
identifier or an endpoint, an identifier needs a secret, an endpoint needs
both.

Places come from built-in functions alone: a text split at a pattern and the
matches of that pattern add up to the place of each match.

Defined results: a null text is an empty one and has no spans; whole texts of
any length are searched; repeated rows yield equal rows; a null id is kept;
columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.llm.rows import row_key
from concord.session import cut_lineage

SCOPE = 200
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Fixed patterns of the sure kinds, in the order in which equal starts are listed.
BASE = (
    ("assign", ASSIGN),
    ("access", r"AKIA[A-Z0-9]{14,}"),
    ("hex", r"[0-9a-f]{16,}"),
)
#: Parts that count only beside others, with the part that each is.
WEAK = (
    ("weak_secret", r"""(?i:pwd|passphrase|credential)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret"),
    ("identifier", r"""(?i:user(?:_?name|_?id)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", "id"),
    ("endpoint", r"""(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis)://[^\s"'<>]+""", "endpoint"),
)
KINDS = [k for k, _ in BASE] + [k for k, _, _ in WEAK]
#: An assigned value of at least this length is a sure finding, a shorter one a weak secret.
VALUE = 12


def _found(text: Column, number: int, pattern: str) -> Column:
    """Kind, lengths of what lies between the matches, and the matches of one pattern; null if there are none."""
    p = F.lit(pattern)
    found = F.struct(
        F.lit(number).alias("kind"),
        F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x)).alias("gaps"),
        F.regexp_extract_all(text, p, F.lit(0)).alias("matches"))
    return F.when(text.rlike(pattern), found)


def parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, and the matches of every pattern) for each row; no text."""
    body = F.coalesce(F.col(text), F.lit(""))
    patterns = [p for _, p in BASE] + [p for _, p, _ in WEAK]
    return docs.select(
        row_key(key, text).alias("row"), F.col(key).alias("key"),
        F.array_compact(F.array(*[_found(body, i, p) for i, p in enumerate(patterns)])).alias("found"))


def spans(found: DataFrame) -> DataFrame:
    """One row for each match with its place: row, kind, start, end, part and whether it stands alone."""
    one = found.select("row", F.explode("found").alias("f")).select(
        "row", "f.kind", F.posexplode(F.arrays_zip(F.col("f.gaps").alias("gap"), F.col("f.matches").alias("m"))))
    # Repeated rows have one set of spans; the last gap has no match after it.
    one = one.where("col.m IS NOT NULL").select("row", "kind", "pos", "col.gap", "col.m").dropDuplicates(
        ["row", "kind", "pos"])
    size = F.char_length("m")
    until = W.partitionBy("row", "kind").orderBy("pos")
    placed = one.withColumn("end", F.sum(F.col("gap") + size).over(until)).withColumn("start", F.col("end") - size)
    long = F.char_length(F.regexp_extract("m", ASSIGN, 1)) >= VALUE
    weak_secret = KINDS.index("weak_secret")
    placed = placed.withColumn("short", (F.col("kind") == 0) & ~long)
    return placed.select(
        "row", F.when(F.col("short"), weak_secret).otherwise(F.col("kind")).alias("kind"), "start", "end",
        ((F.col("kind") < len(BASE)) & ~F.col("short")).alias("sure"),
    ).withColumn(
        "part", F.when(F.col("kind").isin(KINDS.index("access"), KINDS.index("identifier")), "id")
        .when(F.col("kind") == KINDS.index("endpoint"), "endpoint").otherwise("secret"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The sure spans and those weak ones that other parts within ``scope`` characters complete.

    The interval join runs in order of the starts: a part lies in scope if the
    furthest end so far or the nearest start to come is close enough, so no
    pairs are listed, however many spans a text has.
    """
    before = W.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(1, W.unboundedFollowing)

    def near(part: str) -> Column:
        mine = F.col("part") == part
        left = F.max(F.when(mine, F.col("end"))).over(before) >= F.col("start") - scope
        right = F.min(F.when(mine, F.col("start"))).over(after) <= F.col("end") + scope
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    seen = found.select("*", *[near(p).alias(f"near_{p}") for p in ("id", "secret", "endpoint")])
    complete = (
        F.when(F.col("part") == "secret", F.col("near_id") | F.col("near_endpoint"))
        .when(F.col("part") == "id", F.col("near_secret"))
        .otherwise(F.col("near_id") & F.col("near_secret")))
    return seen.where(F.col("sure") | complete).select("row", "kind", "start", "end", "sure", "part")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: the id and its spans (start, kind, end, sure) in order."""
    found = cut_lineage(parts(docs, key, text))
    listed = linked(spans(found), scope).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "sure"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,sure:boolean>>")
    return found.join(listed, "row", "left").select(F.col("key").alias(key), F.coalesce("spans", none).alias("spans"))


def span_text(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
