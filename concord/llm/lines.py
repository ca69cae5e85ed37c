"""Repeated passages of whole lines removed, all of them that hold ``LEAST`` words.

From every line the shortest run of lines that starts there and holds ``LEAST``
words goes by the hash of its lines, and so does the shortest that ends there.
A passage of that many words is covered by those of these runs that lie inside
it, and they are the same wherever it stands. So whatever its length, each of
its lines is found, and each run is compared with its own first occurrence in
the order of (id, line), whatever else a passage shares with other documents.
Runs that copy one text at one distance are joined and removed after byte
comparison.

A line has one word more than blanks; in scripts without blanks each Han or kana
letter, and every four letters of Thai, Lao, Khmer, Burmese or Tibetan, are a
word more.

Defined results: a null text stays null; an empty text is one empty line;
repeated rows (same id and text) are one document, and all of them get its
result; a null id comes first in the order; a run that overlaps its own first
occurrence is no copy; other columns are passed through untouched. No line is
lost: the first occurrence of a passage always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.llm.rows import fresh, row_key
from concord.session import cut_lineage

LEAST = 12
#: Letters that are a word each, and letters of which four are one.
LETTERS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
QUARTERS = r"[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
#: Texts up to this many may be named by a broadcast, after they have been counted.
BROADCAST_ROWS = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    """Words of a line, one at least."""
    unspaced = F.regexp_count(line, F.lit(LETTERS)) + F.floor(F.regexp_count(line, F.lit(QUARTERS)) / 4).cast("int")
    blanks = F.char_length(line) - F.char_length(F.replace(line, F.lit(" ")))
    return blanks + 1 + F.when(F.octet_length(line) == F.char_length(line), 0).otherwise(unspaced)


def _run(words: Column, least: int) -> Column:
    """(k, total) of the shortest beginning of an array that adds up to ``least``, or of all of it."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("total"))
    return F.aggregate(words, start, lambda acc, n: F.when(acc["total"] >= least, acc).otherwise(
        F.struct((acc["k"] + 1).alias("k"), (acc["total"] + n).alias("total"))))


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Shortest runs of ``least`` words from and to every line: row, id, first and last line, and two hashes."""
    line = _lines(F.col(text))
    doc = docs.where(F.col(text).isNotNull()).select(
        row_key(key, text).alias("row"), F.col(key).alias("id"),
        F.transform(line, lambda x: F.xxhash64(x)).alias("h"), F.transform(line, _words).alias("n"))

    def onward(n: Column, i: Column) -> Column:
        run = F.when(n >= least, F.struct(F.lit(1).alias("k"), n.alias("total"))).otherwise(
            _run(F.slice("n", i + 1, least), least))
        return F.struct(i.alias("s"), F.when(run["total"] >= least, run["k"]).alias("k"))

    def back(n: Column, i: Column) -> Column:
        size = F.least(i + 1, F.lit(least))
        run = F.when(n >= least, F.struct(F.lit(1).alias("k"), n.alias("total"))).otherwise(
            _run(F.reverse(F.slice("n", i - size + 2, size)), least))
        # Where the last line is needed, the run has been found from its first line.
        return F.struct((i - run["k"] + 1).alias("s"), F.when(run["total"] - n >= least, run["k"]).alias("k"))

    found = F.concat(F.transform("n", onward), F.transform("n", back))
    doc = doc.withColumn("found", F.filter(found, lambda x: x["k"].isNotNull()))

    def named(x: Column) -> Column:
        content = F.slice("h", x["s"] + 1, x["k"])
        return F.struct(x["s"].alias("s"), (x["s"] + x["k"] - 1).alias("e"), F.xxhash64(content).alias("k1"),
                        F.xxhash64(F.lit("second"), content).alias("k2"))

    return doc.select("row", "id", F.inline(F.transform("found", named)))


def repeats(found: DataFrame) -> DataFrame:
    """Ranges that copy an earlier one: row, s, e, o_row, o_s, o_e."""
    found = cut_lineage(found)
    first = found.groupBy("k1", "k2").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "row", "s", "e")).alias("o")).where("n > 1")
    # Inside one text a copy must not overlap the lines that it is a copy of.
    pair = found.join(first.drop("n"), ["k1", "k2"]).where((F.col("row") != F.col("o.row")) | (F.col("s") > F.col("o.e")))
    grown = pair.select("row", "s", "e", F.col("o.row").alias("o_row"), (F.col("s") - F.col("o.s")).alias("shift")).distinct()
    # Ranges that copy one text at one distance and touch are one range.
    so_far = F.max("e").over(W.partitionBy("row", "o_row", "shift").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1))
    grown = grown.withColumn("opens", F.coalesce(F.col("s") > so_far + 1, F.lit(True)).cast("int")).withColumn(
        "island", F.sum("opens").over(W.partitionBy("row", "o_row", "shift").orderBy("s", "e").rowsBetween(W.unboundedPreceding, 0)))
    merged = grown.groupBy("row", "o_row", "shift", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.select("row", "s", "e", "o_row", (F.col("s") - F.col("shift")).alias("o_s"), (F.col("e") - F.col("shift")).alias("o_e"))


def _part(line: Column, s: Column, e: Column) -> Column:
    return F.array_join(F.slice(line, s + 1, e - s + 1), "\n")


def claims(docs: DataFrame, pairs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row the ranges that may be repeated, with the bytes of their first occurrence."""
    pairs = cut_lineage(pairs)
    owners = pairs.select("o_row", "o_s", "o_e").distinct()
    named = cut_lineage(owners.select("o_row").distinct())
    few = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    bodies = docs.where(F.col(text).isNotNull()).select(row_key(key, text).alias("o_row"), F.col(text).alias("body"))
    bodies = bodies.join(few, "o_row", "left_semi").dropDuplicates(["o_row"])
    ranges = owners.groupBy("o_row").agg(F.collect_list(F.struct("o_s", "o_e")).alias("ranges"))
    line = _lines(F.col("body"))
    read = bodies.join(ranges, "o_row").select("o_row", F.explode(F.transform("ranges", lambda x: F.struct(
        x["o_s"].alias("o_s"), x["o_e"].alias("o_e"), _part(line, x["o_s"], x["o_e"]).alias("part")))).alias("x"))
    read = read.select("o_row", "x.o_s", "x.o_e", "x.part")
    return pairs.join(read, ["o_row", "o_s", "o_e"]).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("s", "e", "part"))).alias("claims"))


def without(docs: DataFrame, claimed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the claimed ranges that hold the very bytes claimed, with n_lines and n_removed (longer if taken)."""
    # The columns of the input travel as one, so that their names cannot clash with those used here.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(key, text).alias("row"))
    joined = whole.join(claimed, "row", "left").withColumn("line", _lines(F.col("doc").getField(text)))

    sound = F.filter("claims", lambda x: _part(F.col("line"), x["s"], x["e"]) == x["part"])
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        slice_ = F.array(F.struct(acc["at"].alias("at"), (x["s"] - acc["at"]).alias("n")))
        return F.struct(
            F.greatest(acc["at"], x["e"] + 1).alias("at"),
            F.when(x["s"] > acc["at"], F.concat(acc["kept"], slice_)).otherwise(acc["kept"]).alias("kept"))

    joined = joined.withColumn("sound", sound).withColumn(
        "walk", F.when(F.size("sound") > 0, F.aggregate("sound", begin, step)))
    rest = F.concat(
        F.flatten(F.transform(F.col("walk")["kept"], lambda x: F.slice("line", x["at"] + 1, x["n"]))),
        F.slice("line", F.col("walk")["at"] + 1, F.size("line")))
    joined = joined.withColumn("rest", F.when(F.col("walk").isNotNull(), rest))
    total = F.when(F.col("line").isNull(), 0).otherwise(F.size("line"))
    old = {c: F.col("doc").getField(c) for c in docs.columns}
    old[text] = F.when(F.col("walk").isNull(), old[text]).otherwise(F.array_join("rest", "\n"))
    return joined.select(
        *[old[c].alias(c) for c in docs.columns], total.alias(fresh(docs, "n_lines")),
        F.when(F.col("walk").isNull(), 0).otherwise(total - F.size("rest")).alias(fresh(docs, "n_removed")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with repeated passages removed but for their first occurrence, and n_lines and n_removed."""
    found = repeats(runs(docs, key, text, least))
    return without(docs, claims(docs, found, key, text), key, text)
