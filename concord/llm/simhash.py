"""Near-duplicates by SimHash fingerprints of 64 bits that differ in at most three.

A bit of a fingerprint is set if it is set in over half the hashes (XXH64, seed
42) of the text's word shingles, repeats included. Fingerprints are cut into two
halves only: of two that differ in three bits at most, one half differs in at
most one. So every half is indexed as it is and with each of its bits left out
(33 keys), fingerprints meet where a key is equal, and all their bits are
compared.

Equal fingerprints are one entry, and a key's entries give a spanning forest of
their links, never all pairs. A half that more than ``HOT`` fingerprints share
is indexed once more by the quarters of the other half, in the same way, which
leaves at most 18 bits open: such a group holds at most 2^18 entries whatever
the size of the corpus, and its links are found by trying all differences of
three bits instead of all pairs.

Defined results: a null or empty text and one without words have the
fingerprint zero and link like any other; rows of one id are one document, so
all their fingerprints are linked; rows without id link like others but name no
component, which is null if it holds no id; every row gives one row; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from concord.llm.graph import components
from concord.llm.text import words
from concord.session import cut_lineage

WORDS = 3
SEED = 42
#: Bits in which linked fingerprints may differ. The index below is made for three.
DIFFER = 3
#: Fingerprints with one half from which on it is indexed further.
HOT = 1024
#: Groups up to this size are compared pair by pair.
PAIRS = 2 * HOT
#: Shingles whose bits are counted in one go.
STEP = 65_536
#: Rows of the index that one task sorts, about.
TASK_ROWS = 2_000_000
_HALF = np.uint64(0xFFFFFFFF)
_SECOND = np.int64(1 << 62)


def fingerprint(text: bytes | None, k: int = WORDS) -> int:
    """The fingerprint of a whole text in UTF-8, as an unsigned number."""
    found = words(text)
    if not found:
        return 0
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    start = np.cumsum(size) - size
    k = min(k, len(found))
    first = start[:len(found) - k + 1]
    last = (start + size - 1)[k - 1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(first), STEP):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(first[i:i + STEP].tolist(), last[i:i + STEP].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) for every row; ``fp`` holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in batch["data"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"id {kind}, fp long")


def _variants(value: np.ndarray, bits: int) -> np.ndarray:
    """(values, bits + 1): each value without one of its bits in turn, tagged with the place; last as it is."""
    place = np.arange(bits, dtype=np.uint64)
    wild = (value[:, None] & ~(np.uint64(1) << place)) | (place << np.uint64(bits))
    return np.hstack([wild, (value | np.uint64(bits << bits))[:, None]])


def index_keys(fp: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, entry) of all index rows. ``hot`` tells for each half which of its 33 keys are indexed further."""
    keys, owners = [], []
    for half in (0, 1):
        own, other = (fp & _HALF, fp >> np.uint64(32)) if half == 0 else (fp >> np.uint64(32), fp & _HALF)
        first = _variants(own, 32) | np.uint64(half << 38)
        further = (hot[half][:, None] >> np.arange(33, dtype=np.uint64)) & np.uint64(1) != 0
        row, col = np.nonzero(~further)
        keys.append(first[row, col])
        owners.append(row)
        row, col = np.nonzero(further)
        if len(row):
            for quarter in (0, 1):
                part = (other[row] >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
                sub = _variants(part, 16) | np.uint64(quarter << 21)
                keys.append(((first[row, col][:, None] << np.uint64(22)) | sub | _SECOND.astype(np.uint64)).ravel())
                owners.append(np.repeat(row, 17))
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of ``n`` places."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
        left = root[a] != root[b]
        a, b = a[left], b[left]
    while (root[root] != root).any():
        root = root[root]
    return root


def group_roots(fp: np.ndarray) -> np.ndarray:
    """For distinct entries of one key, the place of the smallest entry that each reaches by links within the key."""
    if len(fp) <= PAIRS:
        a, b = [], []
        for i in range(0, len(fp), 256):
            row, col = np.nonzero(np.bitwise_count(fp[i:i + 256, None] ^ fp[None, :]) <= DIFFER)
            a.append(row[row + i < col] + i)
            b.append(col[row + i < col])
        return _roots(len(fp), np.concatenate(a), np.concatenate(b))
    # All but a few bits agree: every difference of up to three of the others is tried.
    open_bits = np.bitwise_or.reduce(fp ^ fp[0])
    places = [i for i in range(64) if int(open_bits) >> i & 1]
    small = sum(((fp >> np.uint64(p)) & np.uint64(1)) << np.uint64(j) for j, p in enumerate(places)).astype(np.int64)
    at = np.full(1 << len(places), -1, np.int64)
    at[small] = np.arange(len(fp))
    root = np.arange(len(fp))
    moved = True
    while moved:
        before = root.copy()
        for k in range(1, DIFFER + 1):
            for c in combinations(range(len(places)), k):
                other = at[small ^ sum(1 << j for j in c)]
                there = np.flatnonzero(other >= 0)
                np.minimum.at(root, root[there], root[other[there]])
        while (root[root] != root).any():
            root = root[root]
        moved = (root != before).any()
    return root


def links_of(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (entry, smaller entry) of rows sorted by key; a key's links are a spanning forest."""
    bounds = np.flatnonzero(np.diff(key)) + 1
    start, end = np.append(0, bounds), np.append(bounds, len(key))
    size = end - start
    a, b = [], []
    two = start[size == 2]
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= DIFFER
    a.append(fp[two][near])
    b.append(fp[two + 1][near])
    for i in np.flatnonzero(size > 2):
        own = fp[start[i]:end[i]]
        root = group_roots(own)
        moved = root != np.arange(len(own))
        a.append(own[moved])
        b.append(own[root[moved]])
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of index rows that come sorted by key; a key's rows wait until the next key begins."""
    kept_key, kept_fp = [], []

    def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = links_of(key, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        key, fp = batch["key"].to_numpy(), batch["fp"].to_numpy()
        if not len(key):
            continue
        last = np.searchsorted(key, key[-1])
        if last or (kept_key and kept_key[-1][-1] != key[-1]):
            kept_key.append(key[:last])
            kept_fp.append(fp[:last])
            yield found(np.concatenate(kept_key), np.concatenate(kept_fp))
            kept_key, kept_fp = [], []
        kept_key.append(key[last:])
        kept_fp.append(fp[last:])
    if kept_key:
        yield found(np.concatenate(kept_key), np.concatenate(kept_fp))


def _hot_masks(entries: DataFrame, limit: int) -> DataFrame:
    """(half, value, mask): which keys of a half are shared by halves that more than ``limit`` entries have."""
    halves = F.array(*[F.struct(F.lit(h).alias("half"), F.shiftrightunsigned("fp", 32 * h).bitwiseAND(0xFFFFFFFF).alias("value"))
                       for h in (0, 1)])
    hot = entries.select(F.explode(halves).alias("x")).select("x.*").groupBy("half", "value").count().where(F.col("count") > limit)
    near = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
        F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("value"),
        F.call_function("shiftleft", F.lit(1).cast("long"), i).alias("mask")))
    itself = F.array(F.struct(F.col("value"), F.lit((1 << 33) - 1).cast("long").alias("mask")))
    return hot.select("half", F.explode(F.concat(near, itself)).alias("x")).groupBy("half", "x.value").agg(
        F.bit_or("x.mask").alias("mask"))


def links(entries: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``: enough of them to connect all that differ in up to three bits."""
    masks = cut_lineage(_hot_masks(entries, hot))
    if masks.isEmpty():
        rows = entries.select("fp", F.lit(0).cast("long").alias("m0"), F.lit(0).cast("long").alias("m1"))
    else:
        rows = entries.select("fp", F.col("fp").bitwiseAND(0xFFFFFFFF).alias("v0"), F.shiftrightunsigned("fp", 32).alias("v1"))
        for h in (0, 1):
            part = masks.where(F.col("half") == h).select(F.col("value").alias(f"v{h}"), F.col("mask").alias(f"m{h}"))
            rows = rows.join(part, f"v{h}", "left").withColumn(f"m{h}", F.coalesce(f"m{h}", F.lit(0).cast("long")))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                fp, m0, m1 = (batch[c].to_numpy()[i:i + 4096] for c in ("fp", "m0", "m1"))
                key, owner = index_keys(fp.view(np.uint64), (m0.view(np.uint64), m1.view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[owner])], ["key", "fp"])

    spark = entries.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries.count() * 66 // TASK_ROWS)
    keyed = rows.select("fp", "m0", "m1").mapInArrow(index, "key long, fp long")
    return keyed.repartition(tasks, "key").sortWithinPartitions("key", "fp").mapInArrow(_meet, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Every row's id, fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    rows = cut_lineage(fingerprints(docs, key, text))
    entries = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("low")))
    several = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top")
    same_id = rows.join(several.select("id", "b"), "id").select(F.col("fp").alias("a"), "b")
    part = components(links(entries, hot).union(same_id))
    linked = part.join(entries, part["id"] == entries["fp"]).select("fp", "component", "low")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    named = linked.select("fp", "component").join(lowest, "component").select("fp", F.lit(True).alias("linked"), "component_id")
    known = cut_lineage(entries.join(named, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("low")).alias("component_id")))
    return rows.join(known, "fp").select(F.col("id").alias(key), _hex("fp").alias("fingerprint"), "component_id")


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
