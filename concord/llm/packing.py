"""Packing of token pieces into sequences: length patterns fitted to the histogram.

1. Every text becomes token ids and an end id; only longer documents are cut.
2. The histogram of piece lengths (one row per length, so bounded by the
   sequence length) goes to the driver. Patterns of one to three lengths that
   fill a sequence are enumerated and their repeat counts fitted to the
   histogram by non-negative least squares, then rounded down.
3. What the rounded patterns leave is packed best-fit by run lengths, so the
   work depends on the number of lengths, not of documents.
4. Pieces of one length are interchangeable: a piece's rank among its length
   gives its place. Ranks are counted in buckets of bounded size.

Defined results: a null text is an empty one, whose only id is the end id;
repeated rows are packed each for itself; a null id stays a null id; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from concord.llm.text import steps
from concord.session import cut_lineage, small_table

MAX_LENGTH = 1024
END_ID = 2
#: Rows that share one window when ranks are counted.
BUCKET_ROWS = 512
#: Way in which byte-level vocabularies split a text before merging (a fixed pattern of theirs).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevelTokenizer:
    """Ids of a byte-level BPE vocabulary file, equal to those of ``tokenizers`` without added special tokens.

    ``tiktoken`` merges by the same ranks several times faster. A text that holds
    the string of a special token is left to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.exact = Tokenizer.from_file(path)
        # Printable stand-ins of the bytes: printable ones stand for themselves, the rest follow from 256.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {chr(b): b for b in printable}
        stand_in |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(stand_in[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteLevelTokenizer:
    return ByteLevelTokenizer(path)


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
           max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: key, piece, start, length, ids_crc32 and, if asked for, the ids.

    Documents over ``max_length`` ids are cut into pieces of that length, the
    first of which takes the remainder.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokenizer(vocabulary)
        for batch in batches:
            keys, texts = batch[key].tolist(), batch["text"].tolist()
            for a, b in steps(texts):
                rows = []
                for k, t in zip(keys[a:b], texts[a:b]):
                    ids = np.append(tokens.ids(t or ""), np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(ids) % max_length or max_length, len(ids), max_length), len(ids)]
                    for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[x:y]
                        row = (k, i, x, y - x, zlib.crc32(part.tobytes()))
                        rows.append((*row, part.astype(int).tolist()) if with_ids else row)
                out = pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])
                out[key] = pd.array(out[key], dtype=object)
                yield out

    return docs.select(F.col(key), F.col(text).alias("text")).mapInPandas(run, schema)


def _patterns(lengths: list[int], size: int, spread: int = 24, waste: int = 2) -> list[tuple[int, ...]]:
    """Patterns of one to three of the lengths that fill a sequence up to ``waste``."""
    have = set(lengths)
    found = {(a,) for a in lengths if size - waste <= a <= size}
    middle = lengths[:: max(1, len(lengths) // spread)]
    for a in lengths:
        for w in range(waste + 1):
            b = size - a - w
            if b in have:
                found.add(tuple(sorted((a, b), reverse=True)))
        for b in middle:
            for w in range(waste + 1):
                c = size - a - b - w
                if c in have:
                    found.add(tuple(sorted((a, b, c), reverse=True)))
                    break
    return sorted(found)


def fit_repeats(counts: dict[int, int], patterns: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Repeat counts of the patterns, fitted to the histogram by non-negative least squares.

    Multiplicative steps keep the counts non-negative and never raise the error.
    """
    top = max(counts)
    target = np.zeros(top + 1)
    target[list(counts)] = list(counts.values())
    width = max(map(len, patterns))
    part = np.array([p + (0,) * (width - len(p)) for p in patterns])  # place 0 stands for nothing
    x = np.full(len(patterns), target.sum() / max(1, len(patterns) * 2.0))
    wanted = target[part].sum(axis=1)
    for _ in range(rounds):
        fitted = np.zeros(top + 1)
        for j in range(width):
            fitted += np.bincount(part[:, j], weights=x, minlength=top + 1)
        fitted[0] = 0
        x *= wanted / np.maximum(fitted[part].sum(axis=1), 1e-12)
    return x


def plan(counts: dict[int, int], size: int = MAX_LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of places: (length, first rank, places, places per sequence, first sequence, offset)."""
    left = {n: c for n, c in counts.items() if c > 0}
    bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)  # room -> (sequences, parts)
    patterns = _patterns(sorted(left), size) if left else []
    if patterns:
        repeats = fit_repeats(left, patterns)
        for i in np.argsort(-repeats, kind="stable"):
            parts = sorted(((n, patterns[i].count(n)) for n in set(patterns[i])), reverse=True)
            n = min(int(repeats[i]), *(left[a] // m for a, m in parts))
            if n > 0:
                for a, m in parts:
                    left[a] -= n * m
                bins[size - sum(patterns[i])].append((n, parts))
    for a in sorted((n for n, c in left.items() if c), reverse=True):
        c = left[a]
        for room in range(a, size):
            fit = room // a
            for n, parts in bins.pop(room, []):
                whole = min(n, c // fit)
                rest = min(c - whole * fit, fit - 1) if whole < n else 0
                if whole:
                    bins[room - fit * a].append((whole, [*parts, (a, fit)]))
                if rest:
                    bins[room - rest * a].append((1, [*parts, (a, rest)]))
                if n - whole - bool(rest):
                    bins[room].append((n - whole - bool(rest), parts))
                c -= whole * fit + rest
            if not c:
                break
        fit = size // a
        if c // fit:
            bins[size - fit * a].append((c // fit, [(a, fit)]))
        if c % fit:
            bins[size - c % fit * a].append((1, [(a, c % fit)]))
    out, rank, sequence = [], defaultdict(int), 0
    for room in sorted(bins):
        for n, parts in bins[room]:
            offset = 0
            for a, m in parts:
                out.append((a, rank[a], n * m, m, sequence, offset))
                rank[a] += n * m
                offset += a * m
            sequence += n
    return out


def pack(found: DataFrame, key: str = "doc_id", max_length: int = MAX_LENGTH) -> DataFrame:
    """Every piece with its sequence_id and its offset there. ``found`` should be kept: it is read twice.

    Only the histogram and the runs of places, both bounded by ``max_length``,
    pass through the driver.
    """
    spark = found.sparkSession
    counts = {int(r[0]): int(r[1]) for r in found.groupBy("length").count().collect()}
    runs = plan(counts, max_length)
    # Each length is dealt into as many buckets as its count asks for; at most max_length rows.
    shares = small_table(spark, [(n, max(1, -(-c // BUCKET_ROWS))) for n, c in counts.items()] or [(0, 1)],
                         "length long, buckets long")
    places = small_table(spark, [(*r, r[1] + r[2]) for r in runs] or [(0,) * 7],
                         "length long, first long, places long, each long, sequence long, at long, past long")
    dealt = found.join(F.broadcast(shares), "length").withColumn(
        "bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), "buckets"))
    before = dealt.groupBy("length", "bucket").count().select(
        "length", "bucket",
        (F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = dealt.join(before, ["length", "bucket"]).withColumn(
        "rank", F.col("before") - 1 + F.row_number().over(
            W.partitionBy("length", "bucket").orderBy(key, "piece", "ids_crc32", "start")))
    placed = ranked.join(
        F.broadcast(places.withColumnRenamed("length", "of")),
        (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))
    step = F.col("rank") - F.col("first")
    return placed.select(
        *found.columns,
        (F.col("sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + step % F.col("each") * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
                   max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack; the pieces are written once, so that texts are tokenised once."""
    return pack(cut_lineage(pieces(docs, vocabulary, key, text, max_length, end_id)), key, max_length)
