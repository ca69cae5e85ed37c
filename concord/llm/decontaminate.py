"""Benchmark passages in training texts, found by spaced seeds.

A seed is a fixed mask over neighbouring words: some places count, others are
ignored, so a replaced word at an ignored place does not hide a passage. Seeds
of both sides are joined by hash; each hit fixes how an item lies over a text,
and there the words are compared one by one. An overlap is the best run of that
comparison with at least ``AGREE`` of its words equal. It counts if it has
``RUN`` equal words, whatever the item's length, or half of the item's words.
Where no run does, those of one item that follow each other in both, no further
apart in the text than the item is long, are added up before the half is asked
for, so that inserted and missing words do not hide an item.

Words are compared in lower case (A-Z) and without punctuation. A bitmap of the
benchmark's seeds, of fixed size, spares most seeds of the texts the shuffle;
it only ever lets too many pass.

Defined results: null and empty texts overlap with nothing; items of fewer than
``LEAST_ITEM`` words take no part, as they are common phrases; items too short
for the masks (fewer than nine words) must occur word by word, items of nine and
ten words may have one word replaced; repeated rows are reported once for each distinct (id, text);
a null id is kept; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from concord.llm.rows import row_key
from concord.llm.text import steps, window_hashes, word_hashes
from concord.session import cut_lineage

#: Places of a window that count, for each mask.
MASKS = ((0, 1, 3, 4, 6, 8), (0, 2, 3, 5, 6, 7), (0, 1, 2, 5, 6, 7))
WIDEST = max(m[-1] for m in MASKS) + 1
#: Nine words with the seventh replaced, which none of the masks ignores; for items of just that length.
SEVENTH = (0, 1, 2, 3, 4, 5, 7, 8)
LEAST_ITEM = 4
AGREE = 0.8
#: An overlap has at least this many equal words, and at least this share of the item's.
LEAST_WORDS = 10
LEAST_SHARE = 0.5
#: So many equal words of one run are an overlap, whatever the item's length.
RUN = 13
#: Runs of so many equal words may be added up.
LINK = 6
BITS = 24
BROADCAST_ROWS = 200_000
_PUNCTUATION = b"""!"#$%&'()*+,-./:;<=>?@[]^_`{|}~"""


def plain_words(data: bytes | None) -> np.ndarray:
    return word_hashes(data.lower().translate(None, _PUNCTUATION).split()) if data else np.empty(0, np.uint64)


def _seeds(h: np.ndarray, masks: tuple) -> tuple[np.ndarray, np.ndarray]:
    found = [window_hashes(h, m) + np.uint64(m[-1] * 1000 + len(m)) for m in masks]
    return np.concatenate(found), np.concatenate([np.arange(len(f)) for f in found])


def item_seeds(items: DataFrame, item: str, text: str) -> DataFrame:
    """(seed, item, at, words) of every item; a short one has the single seed of all its words."""
    kind = items.schema[item].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, t in zip(batch["item"], batch["text"]):
                h = plain_words(t)
                if len(h) >= LEAST_ITEM:
                    masks = MASKS + (SEVENTH,) * (len(h) == WIDEST) if len(h) >= WIDEST else (tuple(range(len(h))),)
                    seed, at = _seeds(h, masks)
                    yield pd.DataFrame({"seed": seed.astype(np.int64), "item": pd.array([name] * len(seed), dtype=object),
                                        "at": at.astype(np.int32), "n": np.int32(len(h))})

    return items.select(F.col(item).alias("item"), F.col(text).cast("binary").alias("text")).mapInPandas(
        run, f"seed long, item {kind}, at int, n int")


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value of the seeds' low bits; its size is fixed, whatever the benchmark's."""
    slot = F.col("seed").bitwiseAND((1 << bits) - 1)
    word = F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 AS int))"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for k, v in seeds.groupBy(F.shiftright(slot, 6)).agg(word).collect():
        out[k] = np.uint64(v & 0xFFFFFFFFFFFFFFFF)
    return out


def _text_seeds(docs: DataFrame, bitmap: np.ndarray, masks: tuple, bits: int) -> DataFrame:
    low, six, one = np.uint64((1 << bits) - 1), np.uint64(6), np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, texts = batch["row"].tolist(), batch["text"].tolist()
            for a, b in steps(texts):
                out = []
                for row, t in zip(rows[a:b], texts[a:b]):
                    seed, at = _seeds(plain_words(t), masks)
                    slot = seed & low
                    hit = np.flatnonzero((bitmap[slot >> six] >> (slot & np.uint64(63))) & one)
                    if len(hit):
                        out.append((np.full(len(hit), row, dtype=object), seed[hit].astype(np.int64), at[hit]))
                if out:
                    row, seed, at = (np.concatenate(x) for x in zip(*out))
                    yield pd.DataFrame({"row": row, "seed": seed, "place": at.astype(np.int64)})

    return docs.select("row", F.col("text").cast("binary").alias("text")).mapInPandas(run, "row binary, seed long, place long")


def best_overlap(text: np.ndarray, item: np.ndarray, shift: int, agree: float = AGREE) -> tuple[int, int, int]:
    """(first word of the text, words, equal words) of the best run with ``shift`` words of text before the item."""
    a, b = max(0, shift), min(len(text), shift + len(item))
    if a >= b:
        return 0, 0, 0
    same = text[a:b] == item[a - shift:b - shift]
    # Runs with the wanted share of equal words are those whose gains do not fall below zero.
    gain = np.cumsum(np.where(same, 1 - agree, -agree))
    before = np.concatenate([[0.0], gain[:-1]])
    low = np.minimum.accumulate(before)
    end = int(np.argmax(gain - low))
    first = int(np.flatnonzero(before[:end + 1] == low[end])[0])
    return a + first, end + 1 - first, int(same[first:end + 1].sum())


def whole_overlap(text: np.ndarray, item: np.ndarray, shift: int, agree: float = AGREE) -> tuple[int, int, int]:
    """``best_overlap`` of a short item, but from the first to the last equal word of the item."""
    a, b = max(0, shift), min(len(text), shift + len(item))
    same = np.flatnonzero(text[a:b] == item[a - shift:b - shift]) if a < b else np.empty(0, np.int64)
    return (a + int(same[0]), int(same[-1] - same[0]) + 1, len(same)) if len(same) else (0, 0, 0)


def all_overlaps(text: np.ndarray, item: np.ndarray, shift: int, agree: float = AGREE, link: int = LINK) -> list[tuple[int, int, int]]:
    """Every run of ``best_overlap`` with ``link`` equal words, the best first, then what lies before and after it."""
    a, b = max(0, shift), min(len(text), shift + len(item))
    out, open_ = [], [(a, b)]
    while open_:
        a, b = open_.pop()
        if b - a < link:
            continue
        first, n, equal = best_overlap(text[a:b], item[a - shift:b - shift], 0, agree)
        if equal >= link:
            out.append((a + first, n, equal))
            open_ += [(a, a + first), (a + first + n, b)]
    return out


def chained(runs: list[tuple[int, int, int, int]], reach: int) -> tuple[int, int, int]:
    """(first word, words from there to the end, equal words) of the best chain of runs (first, words, equal, shift).

    Runs follow each other in text and item, at most ``reach`` words of text apart; words that two share count once.
    """
    runs = sorted(set(runs))
    total, begin, longest = [], [], max((r[1] for r in runs), default=0)
    best, low = (0, 0, 0), 0
    for i, (first, n, equal, shift) in enumerate(runs):
        while runs[low][0] + longest + reach < first:
            low += 1
        value, start = equal, first
        for j in range(low, i):
            f, m, _, s = runs[j]
            gap = first - f - m
            if gap > reach or first + n <= f + m or first - shift <= f - s or first - shift + n <= f - s + m:
                continue
            both = max(0, -gap, (f - s + m) - (first - shift))
            if total[j] + equal - both > value:
                value, start = total[j] + equal - both, begin[j]
        total.append(value)
        begin.append(start)
        if value > best[2]:
            best = start, first + n - start, value
    return best


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
             item_text: str = "text", agree: float = AGREE, least_words: int = LEAST_WORDS,
             least_share: float = LEAST_SHARE, run_words: int = RUN, bits: int = BITS) -> DataFrame:
    """(row, key, item, first_word, n_words, n_equal) of every text that holds an item, its best overlap each."""
    kinds = {key: docs.schema[key].dataType.simpleString(), item: items.schema[item].dataType.simpleString()}
    body = docs.select(row_key(key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    seeds = cut_lineage(item_seeds(items, item, item_text))
    short = tuple(tuple(range(r[0])) for r in seeds.where(F.col("n") < WIDEST).select("n").distinct().collect())
    if not seeds.where(F.col("n") == WIDEST).isEmpty():
        short += (SEVENTH,)
    found = _text_seeds(body, _bitmap(seeds, bits), MASKS + short, bits)
    lies = found.join(seeds, "seed").select("row", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    whole = items.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("item_text")).distinct()
    lies = cut_lineage(lies.join(whole, "item").groupBy("row").agg(
        F.collect_set(F.struct("item", "shift", "item_text")).alias("lies")))
    if lies.count() <= BROADCAST_ROWS:
        lies = F.broadcast(lies)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, k, t, where in zip(batch["row"], batch["key"], batch["text"], batch["lies"]):
                h, best, lying = plain_words(t), {}, defaultdict(list)
                for x in where:
                    lying[x["item"], x["item_text"]].append(x["shift"])
                for (name, item_text), shifts in lying.items():
                    own = plain_words(item_text)
                    # Nine and ten words are allowed one that differs, fewer none.
                    whole = len(own) - (WIDEST <= len(own) <= least_words)
                    least = min(whole, max(least_words, -(-least_share * len(own) // 1)))
                    lay = whole_overlap if len(own) <= least_words else best_overlap
                    found = max((lay(h, own, s, agree) for s in shifts), key=lambda v: v[2])
                    counts = found[2] >= min(least, run_words)
                    if found[2] < least and len(own) > least_words:
                        chain = chained([(*v, s) for s in shifts for v in all_overlaps(h, own, s, agree)], len(own))
                        found = max(found, chain, key=lambda v: v[2])
                    if not counts and found[2] < least:
                        continue
                    if found[2] > best.get(name, (0, 0, 0))[2]:
                        best[name] = found
                out += [(row, k, i, *v) for i, v in best.items()]
            found = pd.DataFrame(out, columns=["row", "key", "item", "first_word", "n_words", "n_equal"])
            for name in ("key", "item"):
                found[name] = pd.array(found[name], dtype=object)
            yield found

    return body.join(lies, "row").select("row", "key", F.col("text").cast("binary").alias("text"), "lies").mapInPandas(
        run, f"row binary, key {kinds[key]}, item {kinds[item]}, first_word long, n_words long, n_equal long").distinct()


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the texts that hold a benchmark item."""
    gone = cut_lineage(overlaps(docs, items, key, text, **how).select(F.col("row").alias("_gone")).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, row_key(key, text) == gone["_gone"], "left_anti")
