"""Jaccard join of shingle sets by parity sketches.

A set's sketch has p words of 64 bits. Every shingle XORs its hash into one
word, chosen by the hash; the words that differ between two sketches are at
most as many as the shingles in which the sets differ. Sets that are 80 % alike
differ in at most d = (n_a + n_b) // 9 shingles, so of p > d words at least
p - d agree (pigeonhole). Sketches of one size band share p and are joined on
(band, place, word); a set also enters the next band if a set there may be
alike. Very small sets, where words would often be empty, are joined on the
parity of the set without any one or two of its shingles instead.

Nothing is lost to frequent words. A group of more than ``GROUP`` sets on one
word is linked to its smallest member first. Two sets that meet in such groups
only have many of them, which the sets' own counts show; those few are compared
in a second round, wherever the first has not connected them already.

Candidates are tested by a second sketch of one size for all sets, in which each
shingle flips one bit: no more bits can differ than shingles do. Only what
passes is compared by whole sets.

The joins' keys travel as packed arrays, one row for each input step and
bucket; a bucket's keys are sorted by one task. Copies of a text are one class
from the start, so that a third of all rows being one text costs one row for
each input step.

Defined results: a text of fewer than five words is one shingle; null, empty
and blank texts have none and link with nothing; rows without doc_id are left
out; rows that share a doc_id are one document, linked with whatever any of
them is linked with, and each is returned with its own set size. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from concord.llm.graph import components
from concord.llm.text import mix, shingle_set, steps, words
from concord.session import cut_lineage

SHINGLE = 5
#: Sets up to this size are joined with one or two shingles left out.
SMALL = 13
SMALL_BAND = 63
#: Largest group on one word of which all pairs are looked at directly.
GROUP = 16
#: Members of a larger group in one row.
CHUNK = 4096
#: Numbers of 64 bits in the small sketch that candidate pairs are tested by.
SMALL_SKETCH = 16
#: Ids up to this many may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
SKETCH = [f"z{i}" for i in range(SMALL_SKETCH)]
#: Bits of a key that are compared inside a bucket: 42 of its word's and the band. More candidates may meet, never fewer.
KEPT_BITS = np.uint64((1 << 48) - 1)
_PLACE, _BAND, _EMPTY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@lru_cache(maxsize=1)
def bands() -> np.ndarray:
    """Smallest size of each band; each is about 1.6 times as wide as the one before."""
    low = [SMALL + 1]
    while len(low) < 60:
        low.append(-(-low[-1] * 8 // 5))
    return np.array(low, dtype=np.int64)


def sketch_width(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest size in each band, and how many words its sketches have."""
    high = bands()[band + 1] - 1
    differ = 2 * high // 9
    return high, differ + 1 + np.maximum(12, -(-12 * (differ + 1) // 100))


def _sketch_keys(sets: list[np.ndarray], size: np.ndarray, band: np.ndarray):
    """Keys (owner, key, need) of sketches; need is what a partner must share less its own empty places."""
    owner = np.repeat(np.arange(len(sets)), size)
    h = np.concatenate(sets)
    high, p = sketch_width(band)
    place = ((h >> np.uint64(32)) * p[owner].astype(np.uint64)) >> np.uint64(32)
    # The sets are sorted, so a place's shingles stand side by side.
    start = np.ones(len(h), bool)
    start[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    at = np.flatnonzero(start)
    word = np.bitwise_xor.reduceat(mix(h ^ _PLACE), at)
    owner, place = owner[at], place[at]
    key = mix(word + place * _PLACE + band[owner].astype(np.uint64) * _BAND)
    empty = p - np.bincount(owner, minlength=len(sets))
    differ = (size + np.minimum(high, 5 * size // 4)) // 9
    # A set with so many empty places that they alone could be what it shares also goes by them.
    owners, keys = [owner], [key]
    for i in np.flatnonzero(empty >= p - differ):
        gone = np.setdiff1d(np.arange(p[i], dtype=np.uint64), place[owner == i])
        owners.append(np.full(len(gone), i))
        keys.append(mix(_EMPTY + gone * _PLACE + band[i:i + 1].astype(np.uint64) * _BAND))
    owner, key = np.concatenate(owners), np.concatenate(keys)
    return owner, (key & ~np.uint64(63)) | band[owner].astype(np.uint64), empty


def _small_keys(h: np.ndarray) -> np.ndarray:
    """Parities of a small set without up to as many shingles as an alike set may differ in."""
    n = len(h)
    value = mix(h ^ _PLACE)
    whole = np.bitwise_xor.reduce(value)
    out = [whole]
    for k in range(1, (n + min(SMALL, 5 * n // 4)) // 9 + 1):
        out += [whole ^ np.bitwise_xor.reduce(value[list(c)]) for c in combinations(range(n), k)]
    return (mix(np.unique(np.array(out, np.uint64))) & ~np.uint64(63)) | np.uint64(SMALL_BAND)


def keys_of(classes: np.ndarray, sets: list[np.ndarray]) -> pd.DataFrame:
    """All keys of some sets: key, class, set size, empty places."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    low = bands()
    parts = []
    for i in np.flatnonzero((size > 0) & (size <= SMALL)):
        k = _small_keys(sets[i])
        parts.append((k, np.full(len(k), classes[i]), np.full(len(k), size[i]), np.zeros(len(k), np.int64)))
    own = np.searchsorted(low, size, side="right") - 1
    following = own + 1
    for band, enters in ((own, size > SMALL), (following, 5 * size >= 4 * low[following])):
        which = np.flatnonzero(enters & (size > 0))
        if len(which):
            owner, key, empty = _sketch_keys([sets[i] for i in which], size[which], band[which])
            parts.append((key, classes[which][owner], size[which][owner], empty[owner]))
    if not parts:
        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    key, cls, n, e = (np.concatenate(x) for x in zip(*parts))
    return pd.DataFrame({"key": key, "cls": cls.astype(np.int64), "n": n.astype(np.int32), "e": e.astype(np.int32)})


def _class_of(found: list[bytes]) -> bytes:
    """Digest of a text's words; texts with the same words are one class."""
    return hashlib.md5(b" ".join(found)).digest()


def small_sketch(h: np.ndarray) -> np.ndarray:
    """A bit for each residue of the hashes: whether an odd number of them has it."""
    odd = np.bincount((h % np.uint64(64 * SMALL_SKETCH)).astype(np.int64), minlength=64 * SMALL_SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the words (null without words), set size and small sketch of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digest, size, sketch = [], [], []
            for t in batch["text"].tolist():
                found = words(t)
                own = shingle_set(t, SHINGLE)
                digest.append(_class_of(found) if found else None)
                size.append(len(own))
                sketch.append(small_sketch(own))
            out = pd.DataFrame({"doc_id": batch["doc_id"], "digest": digest, "n_shingles": size})
            bits = np.array(sketch, np.int64).reshape(-1, SMALL_SKETCH)
            yield pd.concat([out.reset_index(drop=True), pd.DataFrame(bits, columns=SKETCH)], axis=1)

    return docs.mapInPandas(run, f"doc_id {kind}, digest binary, n_shingles long, " + ", ".join(f"{z} long" for z in SKETCH))


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of ids whose small sketches differ in no more bits than alike sets may."""
    one = classes.select("rep", F.col("n_shingles").alias("n"), *SKETCH)
    for side in ("a", "b"):
        pairs = pairs.join(one.withColumnsRenamed({"rep": side} | {c: f"{side}_{c}" for c in ("n", *SKETCH)}), side)
    bits = sum((F.bit_count(F.col(f"a_{z}").bitwiseXOR(F.col(f"b_{z}"))) for z in SKETCH), F.lit(0))
    fit = (F.lit(9) * bits <= F.col("a_n") + F.col("b_n")) & F.expr("5 * least(a_n, b_n) >= 4 * greatest(a_n, b_n)")
    return pairs.where(fit).drop(*[f"{s}_{c}" for s in "ab" for c in ("n", *SKETCH)]).distinct()


def _packed_keys(docs: DataFrame, buckets: int) -> DataFrame:
    """Keys of every class of an input step, one row of packed arrays for each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in steps(texts):
                sets = {}
                for t in texts[a:b]:
                    found = words(t)
                    if found:
                        cls = int.from_bytes(_class_of(found)[:8], "big", signed=True)
                        if cls not in sets:
                            sets[cls] = shingle_set(t, SHINGLE)
                keys = keys_of(np.array(list(sets), np.int64), list(sets.values()))
                key = keys["key"].to_numpy()
                bucket = ((key >> np.uint64(6)) % np.uint64(buckets)).astype(np.int64)
                # In a bucket, whose size does not grow with the input, fewer bits tell words apart.
                key = key & KEPT_BITS
                order = np.lexsort((key, bucket))
                cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                packed = {"key": key} | {name: keys[name].to_numpy() for name in ("cls", "n", "e")}
                yield pd.DataFrame({"bucket": bucket[order][cut].astype(np.int32)} | {
                    name: [_narrow(x, name) for x in np.split(value[order], cut[1:])] if len(cut) else []
                    for name, value in packed.items()})

    return docs.select("text").mapInPandas(run, "bucket int, key binary, cls binary, n binary, e binary")


def _narrow(values: np.ndarray, name: str) -> bytes:
    """Numbers without the high bytes that all of them lack; the first byte tells how many bytes are left."""
    wide = np.ascontiguousarray(values).astype("<u8") if name != "cls" else np.ascontiguousarray(values).view("<u8")
    parts = wide.view(np.uint8).reshape(-1, 8)
    kept = 8 if name == "cls" else max(1, 8 - int((parts.max(axis=0, initial=0)[::-1] == 0).argmin()))
    # Bytes of one place stand together, which compresses best.
    return bytes([kept]) + parts[:, :kept].T.tobytes()


def _widened(packed: list[bytes]) -> np.ndarray:
    out = []
    for data in packed:
        kept = data[0]
        parts = np.zeros(((len(data) - 1) // kept, 8), np.uint8)
        parts[:, :kept] = np.frombuffer(data, np.uint8, offset=1).reshape(kept, -1).T
        out.append(parts.view("<u8")[:, 0])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


MET = pa.schema([(name, pa.int64()) for name in ("a", "b", "band", "need", "c", "key")] + [
    (name, pa.list_(pa.int64())) for name in ("members", "limits")])


def _meet(batch: pa.Table) -> pa.Table:
    """Pairs of classes that share keys of one bucket, and the members of its large groups."""
    read = {name: _widened(batch[name].to_pylist()).view(kind)
            for name, kind in (("key", np.uint64), ("cls", np.int64), ("n", np.int64), ("e", np.int64))}
    order = np.lexsort((read["cls"], read["key"]))
    key, cls = read["key"][order], read["cls"][order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls, n, e = key[first], cls[first], read["n"][order][first], read["e"][order][first]
    start = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.empty(0, np.int64)
    length = np.diff(np.append(start, len(key)))
    group = np.repeat(length, length)
    left, right = [], []
    small = np.flatnonzero((group > 1) & (group <= GROUP))
    for gap in range(1, GROUP):
        i = small[:-gap] if gap < len(small) else small[:0]
        i = i[(i + gap < len(key))]
        i = i[key[i] == key[i + gap]]
        if not len(i):
            break
        left.append(i)
        right.append(i + gap)
    large = np.flatnonzero(length > GROUP)
    out = []
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        band = (key[i] & np.uint64(63)).astype(np.int64)
        plain = band != SMALL_BAND
        _, p = sketch_width(np.where(plain, band, 0))
        # Sizes too far apart are never alike.
        fit = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
        need = np.where(plain, p - (n[i] + n[j]) // 9 - np.minimum(e[i], e[j]), 1)
        pairs = pd.DataFrame({"a": cls[i], "b": cls[j], "band": band, "need": need})[fit]
        counted = pairs.groupby(["a", "b", "band", "need"]).size().rename("c").reset_index()
        out.append({name: counted[name].to_numpy(np.int64) for name in counted})
    for g in large:
        own = slice(start[g], start[g] + length[g])
        band = int(key[start[g]] & np.uint64(63))
        if band == SMALL_BAND:
            limit = np.ones(length[g], np.int64)
        else:
            high, p = sketch_width(np.array([band]))
            limit = p - (n[own] + np.minimum(high, 5 * n[own] // 4)) // 9 - e[own]
        cuts = range(0, length[g], CHUNK)
        out.append({"key": key[start[g]:start[g] + 1].view(np.int64).repeat(len(cuts)), "band": np.full(len(cuts), band),
                    "members": [cls[own][c:c + CHUNK] for c in cuts], "limits": [limit[c:c + CHUNK] for c in cuts]})
    tables = []
    for part in out:
        rows = len(next(iter(part.values())))
        tables.append(pa.table([pa.array(part[f.name], type=f.type) if f.name in part else pa.nulls(rows, f.type)
                                for f in MET], schema=MET))
    return pa.concat_tables(tables) if tables else MET.empty_table()


def _verify(docs: DataFrame, pairs: DataFrame, percent: int = 80) -> DataFrame:
    """Those of the pairs (a, b) of doc_ids whose sets are alike, by whole sets."""
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    wanted = _of(docs, ids, "id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            ids, held = [], []
            for k, t in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                # Repeated rows of one task are sent once.
                mark = (k, _class_of(words(t)))
                if mark not in seen:
                    seen.add(mark)
                    ids.append(k)
                    held.append(shingle_set(t, SHINGLE).tobytes())
            yield pd.DataFrame({"id": pd.Series(ids, dtype=batch["doc_id"].dtype), "held": held})

    sets = wanted.mapInPandas(run, f"id {kind}, held binary")

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(x, y):
            s, t = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
            if len(s) > len(t):
                s, t = t, s
            both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(s) else 0
            out.append(bool(both) and 100 * both >= percent * (len(s) + len(t) - both))
        return pd.Series(out, dtype=bool)

    # Many pairs may share their first id, so the sets of the second ids travel there.
    one = pairs.join(sets.withColumnsRenamed({"id": "b", "held": "held_b"}), "b")
    two = one.join(sets.withColumnsRenamed({"id": "a", "held": "held_a"}), "a")
    return two.where(alike("held_a", "held_b")).select("a", "b").distinct()


def near_links(docs: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    """Verified links (a, b) that connect all alike texts of different classes; ids are smallest ids of classes."""
    met = cut_lineage(_packed_keys(docs, buckets).groupBy("bucket").applyInArrow(
        _meet, "a long, b long, band long, need long, c long, key long, members array<long>, limits array<long>"))
    member = F.explode(F.arrays_zip(F.col("members").alias("m"), F.col("limits").alias("w")))
    large = met.where("members IS NOT NULL").select("key", "band", member.alias("x")).select(
        "key", "band", F.col("x.m").alias("cls"), F.col("x.w").alias("lim"))
    often = large.groupBy("cls", "band").agg(F.count("*").alias("large"), F.min("lim").alias("lim"))
    shared = met.where("a IS NOT NULL").groupBy("a", "b", "band").agg(F.sum("c").alias("c"), F.max("need").alias("need"))
    for side in ("a", "b"):
        shared = shared.join(
            often.select(F.col("cls").alias(side), "band", F.col("large").alias(f"large_{side}")), [side, "band"], "left")
    enough = shared.where(
        F.col("c") + F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0))) >= F.col("need"))
    low = classes.select("cls", "rep", F.col("n_shingles").alias("n"))
    # A large group is first linked to that member which is in most large groups, as an original among its edits is.
    member = cut_lineage(large.join(often.select("cls", "band", "large"), ["cls", "band"]).join(low, "cls"))
    star = member.join(_center(member, "key"), "key").where("rep <> center")
    star = star.groupBy(F.col("rep").alias("a"), F.col("center").alias("b")).count()
    star = cut_lineage(_close(star, classes).withColumnsRenamed({"a": "rep", "b": "center"}))
    first = star.groupBy("rep").agg(F.max_by("center", F.struct("count", "center")).alias("center"))
    pairs = enough.select("a", "b").distinct().join(low.select(F.col("cls").alias("a"), F.col("rep").alias("x")), "a").join(
        low.select(F.col("cls").alias("b"), F.col("rep").alias("y")), "b").select("x", "y")
    pairs = cut_lineage(_close(_ordered(pairs, "x", "y"), classes).union(_ordered(star, "rep", "center")).distinct())
    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = cut_lineage(_verify(docs, _ordered(nearest.union(first.select("rep", "center")), "a", "b")))

    # What the first links have not connected: the other pairs, and sets with so many
    # large groups that these may be all they share with an alike set.
    known = components(links)
    rest = _placed(_placed(pairs, known, "a", "pa"), known, "b", "pb").where("pa <> pb").select("a", "b")
    # Such sets share at least lim of their large groups, so they meet in one even if each counts
    # only the first of its groups in the order of the keys, lim - 1 fewer than it has.
    place = F.row_number().over(W.partitionBy("cls", "band").orderBy("key"))
    first_groups = member.where("large >= lim").withColumn("place", place).where("place <= large - lim + 1")
    busy = _mixed(first_groups.select("key", "rep", "n"), known).select("rep", "part").distinct()
    rare = _mixed(_rare_shingles(docs, cut_lineage(busy), max(1, buckets // 8)), known)
    others = rare.join(_main_part(rare), "key").where("part <> main").select(
        "key", F.col("rep").alias("o"), F.col("part").alias("op"), F.col("n").alias("o_n"), F.col("place").alias("o_place"))
    # At the first shingle that two sets share, what follows in both must hold enough for them to be alike.
    across = others.join(rare, "key").where(
        "op <> part AND 9 * (least(n - place, o_n - o_place) + 1) >= 4 * (n + o_n)").select(
        F.col("o").alias("a"), F.col("rep").alias("b"))
    more = cut_lineage(_close(_ordered(rest.union(across), "a", "b"), classes))
    return cut_lineage(links.union(_verify(docs, more)))


HELD = pa.schema([("bucket", pa.int32())] + [(name, pa.binary()) for name in ("key", "code", "n", "often")])


def _rare_shingles(docs: DataFrame, ids: DataFrame, buckets: int | None = None) -> DataFrame:
    """(key, rep, n, place): the rarest shingles of each text of some documents, as many as an alike set must share one of.

    ``ids`` gives their ids (rep) and components (part), else each is one of its
    own. Sets of n shingles that are 80 % alike share at least 80 % of n; leaving
    out one fewer than that many of the most frequent, they still share one. Only
    links between components are wanted, so a shingle that one component alone has
    comes before all others, and a text with more than 20 % of such shingles goes.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = "part" if "part" in ids.columns else "rep"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mark = [int.from_bytes(_class_of(words(t))[:8], "big", signed=True) for t in batch["text"]]
            yield pd.DataFrame({"rep": batch["doc_id"], "mark": np.array(mark, np.int64), "text": batch["text"]})

    def shared(batch: pa.Table) -> pa.Table:
        read = _read(batch, ("key", "part", "code", "n"))
        order = np.lexsort((read["part"], read["key"]))
        key, part, code, n = (x[order] for x in read.values())
        start = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        often = np.diff(np.append(start, len(key)))
        mixed = np.repeat(part[start] != part[start + often - 1], often)
        often = np.repeat(often, often).astype(np.uint64)
        found = {"key": key, "code": code, "n": n, "often": often}
        found = {name: x[mixed] for name, x in found.items()}
        return pa.Table.from_pandas(_dealt_out(found, mix(found["code"]), buckets), schema=HELD, preserve_index=False)

    def first(batch: pa.Table) -> pa.Table:
        read = _read(batch, ("key", "code", "n", "often"))
        order = np.lexsort((read["key"], read["often"], read["code"]))
        key, code, n, _ = (x[order].astype(np.int64) for x in read.values())
        start = np.flatnonzero(np.diff(code, prepend=~code[:1]))
        many = np.diff(np.append(start, len(code)))
        place = n - np.repeat(many + start, many) + np.arange(len(code)) + 1
        kept = place <= n - (4 * n + 4) // 5 + 1
        return pa.table({"code": code[kept], "key": key[kept], "n": n[kept], "place": place[kept]})

    # Repeated rows count once, and each text of a document has places of its own.
    texts = _of(docs, ids, "rep").mapInPandas(marked, f"rep {kind}, mark long, text binary")
    texts = texts.groupBy("rep", "mark").agg(F.min("text").alias("text")).join(
        ids.select("rep", F.xxhash64(part).alias("part")), "rep")
    texts = cut_lineage(texts.select("rep", "part", "text", F.monotonically_increasing_id().alias("code")))
    held = _packed_shingles(texts, buckets).groupBy("bucket").applyInArrow(
        shared, "bucket int, key binary, code binary, n binary, often binary")
    places = held.groupBy("bucket").applyInArrow(first, "code long, key long, n long, place long")
    return cut_lineage(places.join(texts.select("code", "rep"), "code").select("key", "rep", "n", "place"))


def _packed_shingles(texts: DataFrame, buckets: int) -> DataFrame:
    """Shingles of (part, text, code), one row of packed arrays for each input step and bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in steps(batch["text"].tolist()):
                rows = batch.iloc[a:b]
                sets = [shingle_set(t, SHINGLE) for t in rows["text"]]
                size = np.array([len(s) for s in sets], np.int64)
                held = {"key": np.concatenate(sets), "n": np.repeat(size, size).astype(np.uint64)} | {
                    name: np.repeat(rows[name].to_numpy(np.int64).view(np.uint64), size) for name in ("part", "code")}
                yield _dealt_out(held, held["key"], buckets)

    return texts.select("part", "text", "code").mapInPandas(run, "bucket int, key binary, part binary, code binary, n binary")


def _dealt_out(values: dict[str, np.ndarray], by: np.ndarray, buckets: int) -> pd.DataFrame:
    """Arrays of one length, packed by bucket."""
    bucket = (by % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return pd.DataFrame({"bucket": bucket[order][cut].astype(np.int32)} | {
        name: pd.Series([_narrow(x, name) for x in np.split(value[order], cut[1:])] if len(cut) else [], dtype=object)
        for name, value in values.items()})


def _read(batch: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {name: _widened(batch[name].to_pylist()) for name in names}


def _of(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Documents with these ids; few ids are broadcast, after they have been counted."""
    hint = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(hint, docs["doc_id"] == ids[column], "left_semi")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def _placed(df: DataFrame, known: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the component of ``column``, itself if it has none."""
    k = known.select(F.col("id").alias(column), F.col("component").alias(name))
    return df.join(k, column, "left").withColumn(name, F.coalesce(name, column))


def _center(member: DataFrame, by: str) -> DataFrame:
    return member.groupBy(by).agg(F.max_by("rep", F.struct("large", "rep")).alias("center"))


def _mixed(member: DataFrame, known: DataFrame) -> DataFrame:
    """Members of those groups that lie in more than one component."""
    placed = _placed(member, known, "rep", "part")
    mixed = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("key")
    return cut_lineage(placed.join(mixed, "key"))


def _main_part(member: DataFrame) -> DataFrame:
    """The component with most members in each group."""
    return member.groupBy("key", "part").count().groupBy("key").agg(
        F.max_by("part", F.struct("count", "part")).alias("main"))


def near_duplicates(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    ``buckets`` defaults to eight times the session's shuffle partitions, so that
    tasks get even shares and what one sorts keeps its size as the input grows.
    """
    spark = docs.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = cut_lineage(_classes(docs))
    reps = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"),
        *[F.max(z).alias(z) for z in SKETCH])
    # The first eight bytes are the class number of the keys.
    number = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    reps = cut_lineage(reps.withColumn("cls", number))
    links = near_links(docs, reps, buckets)
    owned = rows.select("doc_id", "digest", "n_shingles").join(reps.select("digest", "rep"), "digest", "left")
    # Rows of one id are one document.
    spread = owned.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    same = spread.join(owned.select("doc_id", F.col("rep").alias("b")), "doc_id").select("a", "b")
    # An id whose smallest row belongs to another class is reached through that class.
    known = components(links.union(same))
    return owned.join(known, owned["rep"] == known["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
