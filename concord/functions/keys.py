"""Identity keys at rising strictness, and vocabularies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Shingles whose places a task keeps at once.
REMEMBERED = 1 << 20


def identity_keys(df: DataFrame, text: str, fine: Column, coarse: Column) -> DataFrame:
    """Attach both keys as column expressions; a failed key stays null."""
    return df.withColumns({"fine_key": fine, "coarse_key": coarse})


def identity_keys_with(df: DataFrame, text: str, keys: Callable[[str], tuple[str | None, str | None]]) -> DataFrame:
    """Attach both keys from a user function, called once per distinct text.

    A text for which the function fails gets null keys and the error's name in ``key_error``.
    """
    def run(batches):
        for batch in batches:
            made = []
            for value in batch[text]:
                try:
                    made.append((*keys(value), None))
                except Exception as e:
                    made.append((None, None, type(e).__name__))
            yield pd.DataFrame({text: batch[text]} | {
                name: [m[i] for m in made] for i, name in enumerate(("fine_key", "coarse_key", "key_error"))})

    distinct = df.select(text).where(F.col(text).isNotNull()).distinct()
    made = distinct.mapInPandas(run, f"`{text}` string, fine_key string, coarse_key string, key_error string")
    return df.join(made, text, "left")


def key_ladder(text: str) -> dict[str, Column]:
    """Keys from exact to loose, a multi-part flag and whether keys could be made."""
    t = F.col(text)
    letters = F.nullif(F.regexp_replace(F.lower(t), "[^a-z]", ""), F.lit(""))
    return {
        "exact": F.md5(t.cast("binary")),
        "folded": F.md5(F.lower(t).cast("binary")),
        "spaceless": F.md5(F.regexp_replace(F.lower(t), "[ \\t\\n\\r\\f]+", "").cast("binary")),
        "letters": F.md5(letters.cast("binary")),
        "words": word_set(t),
        "multi_part": F.contains(F.trim(t), F.lit("\n")),
        "ok": letters.isNotNull(),
    }


def word_set(text: Column) -> Column:
    """Loose key of a whole text: the digest of its sorted distinct words; null without a letter a-z."""
    words = F.array_sort(F.array_remove(F.array_distinct(F.split(F.lower(text), "[^a-z]+")), ""))
    return F.when(F.size(words) > 0, F.md5(F.array_join(words, " ").cast("binary")))


def group_key(expr: Column) -> Column:
    return F.coalesce(expr, F.lit("INVALID"))


def fit_vocab(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, slot): sorted distinct values per column, from slot 1.

    A vocabulary is what one-hot width can bear, so ranking it per column is bounded.
    """
    from pyspark.sql import Window as W

    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("p")).select("p.*").where("value IS NOT NULL").distinct()
    return pairs.withColumn("slot", F.row_number().over(W.partitionBy("column").orderBy("value")))


def one_hot(df: DataFrame, vocab: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<c>_slot`` and the 0/1 array ``<c>_hot``; unknown values use slot 0."""
    for c in cols:
        mine = vocab.where(F.col("column") == c).select(F.col("value").alias(c), F.col("slot").alias(f"{c}_slot"))
        width = mine.agg(F.coalesce(F.max(f"{c}_slot"), F.lit(0)))
        df = df.join(mine, c, "left").withColumns({
            f"{c}_slot": F.coalesce(f"{c}_slot", F.lit(0)), "_width": width.scalar(),
        }).withColumn(
            f"{c}_hot", F.transform(F.sequence(F.lit(0), F.col("_width")), lambda i: (i == F.col(f"{c}_slot")).cast("int"))
        ).drop("_width")
    return df


def mean_pool(df: DataFrame, key: str, vector: str, mask: str) -> DataFrame:
    """Masked mean of a key's vectors; an all-masked key yields zeros."""
    parts = df.select(key, F.col(mask).cast("double").alias("_m"), F.posexplode(vector).alias("_pos", "_v"))
    summed = parts.groupBy(key, "_pos").agg(
        (F.sum(F.col("_v") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(1.0))).alias("_x")
    )
    ordered = F.sort_array(F.collect_list(F.struct("_pos", "_x")))
    return summed.groupBy(key).agg(F.transform(ordered, lambda s: s["_x"]).alias("pooled"))


def hashed_features(df: DataFrame, text: str, n: int = 2048, width: int = 4) -> DataFrame:
    """Binary hashed shingle vector of the text, as an ``ml`` vector column ``features``.

    One regular expression finds all shingles: it looks ``width`` characters
    ahead and goes on by one, so the work grows with the text's length alone.
    """
    from pyspark.ml.feature import HashingTF

    found = F.regexp_extract_all("_tidy", F.lit(f"(?s)(?=(.{{{width}}}))."), F.lit(1))
    # A short text is one shingle, and so is a missing one.
    whole = F.col("_tidy").isNull() | (F.char_length("_tidy") < width)
    shingles = F.when(whole, F.array("_tidy")).otherwise(F.array_distinct(found))
    shingled = df.withColumn("_tidy", _tidied(F.col(text))).withColumn("_shingles", shingles)
    made = HashingTF(inputCol="_shingles", outputCol="features", numFeatures=n, binary=True).transform(shingled)
    return made.drop("_tidy", "_shingles")


def _tidied(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), "[ \\t\\n\\r\\f]+", " "))


class _Places(dict):
    """Places of the shingles that a task has met."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, shingle: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[shingle] = place = int(hashlib.md5(shingle.encode()).hexdigest()[:8], 16) % self.n
        return place


def bit_positions(text: Column, n: int = 2048, width: int = 4) -> Column:
    """Positions of a text's character shingles, by the first 8 hex digits of their md5 modulo ``n``.

    Case and runs of white space do not count; a text shorter than ``width`` is
    one shingle, a missing text has none. A shingle's digest is made once per
    task, as texts share most of theirs.
    """
    @F.pandas_udf("array<int>")
    def positions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = _Places(n)
        for batch in batches:
            yield pd.Series([np.empty(0, np.int32) if t is None else np.array(sorted({
                places[s] for s in {t[i:i + width] for i in range(max(len(t) - width + 1, 1))}}), np.int32)
                for t in batch], dtype=object)

    return positions(_tidied(text))


def packed_bits(df: DataFrame, positions: Column, n: int, out: str = "bits") -> DataFrame:
    """``df`` with positions as ``n`` packed bits, the lowest bit of a byte first; a null list or place sets none."""
    width = -(-n // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for found in batch[out]:
                bits = np.zeros(8 * width, np.uint8)
                if found.is_valid:
                    bits[found.values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)] = 1
                made.append(np.packbits(bits, bitorder="little").tobytes())
            yield batch.set_column(batch.schema.get_field_index(out), out, pa.array(made, pa.binary()))

    rows = df.withColumn(out, positions)
    schema = T.StructType([f if f.name != out else T.StructField(out, T.BinaryType()) for f in rows.schema.fields])
    return rows.mapInArrow(run, schema)


def hashed_bits(df: DataFrame, text: str, n: int = 2048, width: int = 4, out: str = "bits") -> DataFrame:
    """``df`` with the packed bits of a text's shingles; a null text has none set."""
    return packed_bits(df, bit_positions(F.col(text), n, width), n, out)


def vector_bits(df: DataFrame, vector: str, n: int, out: str = "bits") -> DataFrame:
    """``df`` with the places of an ``ml`` vector that are not zero as packed bits, instead of the vector."""
    v = F.unwrap_udt(vector)
    places = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    set_ones = F.filter(F.arrays_zip(places.alias("i"), v["values"].alias("x")), lambda s: s["x"] != 0)
    return packed_bits(df.withColumn(vector, F.transform(set_ones, lambda s: s["i"])), F.col(vector), n, out).drop(vector)
