"""Hard negatives: for anchors and their nearest rows of the same label, the best rows of other labels in a band below.

Vectors are whole numbers (components times ``SCALE``, rounded down), scores are
exact inner products. Rows are kept in buckets of one label and of neighbouring
lengths, each with a sorted list of every coordinate of its unit vectors. An
anchor that needs a score of at least t has to agree with a row of a bucket by
the cosine t / (anchor's length * bucket's longest); that bounds the row's value
on any one coordinate. The ranges of the anchor's largest coordinates (its focus)
are looked up in the sorted lists, only rows inside all of them are candidates,
and their scores are computed. A bucket too short for any candidate is passed
over; one whose ranges leave most rows is computed at once.

The first thresholds come from a bounded sample of ``SAMPLE`` rows: a score that
enough rows of the sample reach is reached by the result. Every row is then
searched, anchors and buckets meeting in blocks: (bucket, group of anchors) is
one task's input, so neither a label that many rows share nor many copies of a
vector put more into a task, and a bucket returns no more than the rows asked
for. No two rows are compared unless one is an anchor.

Defined results: rows without id or label, and those whose vector is null, holds
null or non-finite components or has another length than most take no part; of
rows that share an id the smallest (label, vector) counts; an anchor without
positives has no rows, neither has a positive without rows in its band; with
fewer rows than asked for, all are returned; other columns are not read.
Components so large that a score might not fit 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.session import cut_lineage

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Bounds of a negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
BUCKET = 2048
#: Anchors in one task's group, about, and in one step there.
CHUNK, STEP = 4096, 256
SAMPLE = 4096
FOCUS = 4
#: Share of a bucket inside the narrowest range from which on the whole bucket is computed.
WIDE = 0.25
NONE = -(1 << 62)


# one bucket ----------------------------------------------------------------------------------------------------


class Bucket:
    """Rows of one label in order of their ids, and the order of each coordinate of their unit vectors."""

    def __init__(self, label: int, ids: np.ndarray, x: np.ndarray, order: np.ndarray | None = None):
        self.label, self.ids, self.x = label, ids, x
        self.wide = _exact(x)
        self.norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        self.longest = float(self.norm.max(initial=0.0))
        unit = x / np.maximum(self.norm, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").T if order is None else order
        self.lists = np.take_along_axis(unit.T, self.order.astype(np.int64), axis=1)

    def candidates(self, q: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row, score) of every pair with a score of at least ``need``, in parts."""
        length = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(need > 0, need / (length * self.longest), -1.0)
        able = np.flatnonzero(~(cosine > 1 + 1e-9))
        first, last, focus = self._ranges(q[able], length[able], np.minimum(cosine[able], 1.0))
        narrow = (last - first).min(axis=1, initial=len(self.ids)) < WIDE * len(self.ids)
        whole = able[~narrow]
        for at in range(0, len(whole), STEP):
            part = whole[at:at + STEP]
            score = _exact(q[part]) @ self.wide.T
            row, col = np.nonzero(score >= need[part, None])
            yield part[row], col, score[row, col].astype(np.int64)
        for i, a, b, f in zip(able[narrow], first[narrow], last[narrow], focus[narrow]):
            met = np.zeros(len(self.ids), np.uint8)
            for k in range(len(f)):
                met[self.order[f[k], a[k]:b[k]]] += 1
            col = np.flatnonzero(met == len(f))
            score = (self.wide[col] @ _exact(q[i])).astype(np.int64)
            kept = score >= need[i]
            yield np.full(int(kept.sum()), i), col[kept], score[kept]

    def _ranges(self, q: np.ndarray, length: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feasible places [first, last) in the lists of each anchor's focus coordinates."""
        unit = q / np.maximum(length, 1e-300)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        v = np.take_along_axis(unit, focus, axis=1)
        c = cosine[:, None]
        swing = np.sqrt(np.maximum((1 - v * v) * (1 - c * c), 0))
        low = np.where((c <= 0) | (v <= -c), -1.0, v * c - swing) - 1e-9
        high = np.where((c <= 0) | (v >= c), 1.0, v * c + swing) + 1e-9
        first, last = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(self.ids))
        for f in np.unique(focus):
            here = focus == f
            first[here] = np.searchsorted(self.lists[f], low[here], side="left")
            last[here] = np.searchsorted(self.lists[f], high[here], side="right")
        return first, np.maximum(first, last), focus


def _exact(x: np.ndarray) -> np.ndarray:
    """Numbers whose inner products are exact: doubles as long as these hold all sums."""
    largest = int(np.abs(x).max(initial=0))
    return x.astype(float) if x.shape[-1] * max(largest, 1 << 20) ** 2 < 1 << 53 else x.astype(np.int64)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group by score, highest first, and id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.diff(g, prepend=-1)) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


def best_positives(bucket: Bucket, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, need: np.ndarray, k: int):
    """(anchor, row id, score): each anchor's first ``k`` other rows of a bucket of its label, with scores from ``need``."""
    own = np.flatnonzero(labels == bucket.label)
    found = [(own[a], r, s) for a, r, s in bucket.candidates(q[own], need[own])]
    a, r, s = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    other = ids[a] != bucket.ids[r]
    a, r, s = a[other], bucket.ids[r[other]], s[other]
    kept = _first(a, s, r, k)
    return a[kept], r[kept], s[kept]


def best_negatives(bucket: Bucket, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """(anchor, positive, row id, score): the first ``k`` rows of another label inside each of an anchor's bands.

    ``low`` and ``high`` are (anchors, positives); a missing positive has low above high.
    """
    own = np.flatnonzero((labels != bucket.label) & (low <= high).any(axis=1))
    need = np.where(low <= high, low, 1 << 62).min(axis=1, initial=1 << 62)
    found = [(own[a], r, s) for a, r, s in bucket.candidates(q[own], need[own])]
    a, r, s = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    out = []
    for p in range(low.shape[1]):
        inside = np.flatnonzero((s >= low[a, p]) & (s <= high[a, p]))
        kept = inside[_first(a[inside], s[inside], bucket.ids[r[inside]], k)]
        out.append((a[kept], np.full(len(kept), p), bucket.ids[r[kept]], s[kept]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 4


# tables --------------------------------------------------------------------------------------------------------


def whole_numbers(rows: DataFrame, key: str, vector: str, label: str, relabel: Column | None = None) -> DataFrame:
    """(id, label, v): the rows that take part, with vectors of whole numbers. ``relabel`` may use id and label."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    out = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & sound).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))).alias("v"))
    out = cut_lineage(out if relabel is None else out.withColumn("label", relabel))
    sizes = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    out = out.where(F.size("v") == (sizes[0][0] if sizes else 0))
    several = cut_lineage(out.groupBy("id").count().where("count > 1").select("id"))
    if several.isEmpty():
        return out
    one = out.join(several, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x"))
    return cut_lineage(out.join(several, "id", "left_anti").union(one.select("id", "x.label", "x.v")))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def buckets(rows: DataFrame, count: int, size: int = BUCKET) -> DataFrame:
    """(label, first, ids, vectors, order): buckets of one label and neighbouring lengths, as packed arrays."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, x = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            by_id = np.argsort(ids, kind="stable")
            b = Bucket(held[0][0], ids[by_id], x[by_id])
            held.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([b.label], pa.int64()), pa.array([int(b.ids[0])], pa.int64()), pa.array([b.ids.tobytes()], pa.binary()),
                pa.array([b.x.tobytes()], pa.binary()), pa.array([b.order.astype(np.uint16).tobytes()], pa.binary())],
                ["label", "first", "ids", "vectors", "order"])

        for batch in batches:
            label, ids, x = batch["label"].to_numpy(), batch["id"].to_numpy(), _matrix(batch["v"])
            at = 0
            while at < len(ids):
                room = size - sum(len(h[1]) for h in held)
                same = np.flatnonzero(label[at:at + room] != label[at])
                end = at + (int(same[0]) if len(same) else len(label[at:at + room]))
                if held and held[0][0] != label[at]:
                    yield flush()
                    continue
                held.append((int(label[at]), ids[at:end], x[at:end]))
                at = end
                if sum(len(h[1]) for h in held) == size:
                    yield flush()
        if held:
            yield flush()

    length = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    sorted_rows = rows.withColumn("length", length)
    keys = [F.col("label"), F.desc("length"), F.col("id")]
    parts = max(1, -(-count // (8 * size)))
    return sorted_rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("id", "label", "v").mapInArrow(
        pack, "label long, first long, ids binary, vectors binary, order binary")


def _unpack(table: pa.Table, dim: int) -> Iterator[Bucket]:
    for r in table.select(["label", "ids", "vectors", "order"]).to_pylist():
        yield Bucket(r["label"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(-1, dim),
                     np.frombuffer(r["order"], np.uint16).reshape(dim, -1))


def _with_slots(df: DataFrame, sizes: DataFrame) -> DataFrame:
    return df.alias("d").join(sizes.alias("s"), "label").select("d.*", "s.slots")


def _meet(anchors: DataFrame, packs: DataFrame, own_label: bool, chunks: int,
          answer: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``answer`` for every group of anchors and every bucket; with ``own_label`` only for buckets of the anchors' label.

    The column ``slots`` of both is the number of groups of buckets (of the label).
    """
    part = F.col("label") if own_label else F.lit(0).cast("long")
    left = anchors.select("*", part.alias("part"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("long").alias("chunk"),
                          F.explode(F.expr("sequence(0L, slots - 1)")).alias("slot"))
    right = packs.select("*", part.alias("part"), F.expr("pmod(xxhash64(first), slots)").alias("slot"),
                         F.explode(F.expr(f"sequence(0L, {chunks - 1}L)")).alias("chunk"))
    keys = ["part", "slot", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(answer, schema)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, bucket: int = BUCKET, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``whole_numbers`` rows."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = cut_lineage(rows)
    count, dim, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    asked = cut_lineage(rows.where(is_anchor))
    n_asked = asked.count()
    if not n_asked or not dim:
        return rows.sparkSession.createDataFrame([], schema)
    if dim * largest**2 >= 1 << 62:
        raise ValueError(f"components up to {largest} in {dim} dimensions give scores beyond 64 bits")

    share = min(1.0, 0.75 * sample / count)
    seen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample).collect()
    known: dict[int, list] = {}
    for r in sorted(seen, key=lambda r: r.id):
        known.setdefault(r.label, []).append(r)
    # Bounded by ``sample``: travels with the functions below.
    packed = [(k, np.array([r.id for r in v]), np.array([r.v for r in v], np.int64)) for k, v in known.items()]
    sizes = cut_lineage(rows.groupBy("label").agg(F.ceil(F.count("*") / bucket).cast("long").alias("slots")))
    all_slots = F.lit(-(-count // bucket)).cast("long")
    packs = cut_lineage(buckets(rows, count, bucket))
    chunks = max(1, -(-n_asked // chunk))

    # Positives: what the sample reaches is the least that counts.
    def first_need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Bucket(*p) for p in packed]
        for batch in batches:
            ids, labels, q = batch["id"].to_numpy(), batch["label"].to_numpy(), _matrix(batch["v"])
            need = np.full(len(ids), NONE, np.int64)
            for b in own:
                a, _, s = best_positives(b, ids, labels, q, need, positives)
                full = np.flatnonzero(np.bincount(a, minlength=len(ids)) == positives)
                worst = np.full(len(ids), 1 << 62)
                np.minimum.at(worst, a, s)
                need[full] = worst[full]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["v"], pa.array(need)], ["id", "label", "v", "need"])

    def positive_answer(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, need = (left[c].to_numpy() for c in ("id", "label", "need"))
        q, out = _matrix(left["v"]), [(np.empty(0, np.int64),) * 3]
        for b in _unpack(right, dim):
            a, r, s = best_positives(b, ids, labels, q, need, positives)
            out.append((ids[a], r, s))
        return pa.table(dict(zip(("anchor", "id", "score"), (np.concatenate(c) for c in zip(*out)))))

    ready = asked.mapInArrow(first_need, "id long, label long, v array<long>, need long")
    near = _meet(_with_slots(ready, sizes), _with_slots(packs, sizes), True, chunks, positive_answer, "anchor long, id long, score long")
    top = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = cut_lineage(near.withColumn("r", F.row_number().over(top)).where(F.col("r") <= positives))

    # Negatives: a band below every positive, narrowed by what the sample holds in it.
    bands = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("r", "score"))).alias("p")).select(
        F.col("anchor").alias("id"), F.col("p.score").alias("scores"))

    def band_need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Bucket(*p) for p in packed]
        for batch in batches:
            labels, q = batch["label"].to_numpy(), _matrix(batch["v"])
            least, most = _bands(batch["scores"].to_pylist(), positives, low, high)
            held = [best_negatives(b, labels, q, least, most, negatives) for b in own]
            a, p, r, s = (np.concatenate(c) for c in zip(*held))
            pair = a * positives + p
            kept = _first(pair, s, r, negatives)
            pair, s = pair[kept], s[kept]
            full = np.bincount(pair, minlength=least.size) == negatives
            worst = np.full(least.size, 1 << 62)
            np.minimum.at(worst, pair, s)
            least = np.where(full, worst, least.ravel()).reshape(least.shape)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["label"], batch["v"], pa.array(list(least)), pa.array(list(most))],
                ["id", "label", "v", "least", "most"])

    def negative_answer(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, q = left["id"].to_numpy(), left["label"].to_numpy(), _matrix(left["v"])
        out = [(np.empty(0, np.int64),) * 4]
        for b in _unpack(right, dim) if len(ids) else ():
            a, p, r, s = best_negatives(b, labels, q, _matrix(left["least"]), _matrix(left["most"]), negatives)
            out.append((ids[a], p + 1, r, s))
        return pa.table(dict(zip(("anchor", "r", "id", "score"), (np.concatenate(c) for c in zip(*out)))))

    ready = asked.join(bands, "id").mapInArrow(
        band_need, "id long, label long, v array<long>, least array<long>, most array<long>")
    hard = _meet(ready.withColumn("slots", all_slots), packs.withColumn("slots", all_slots), False, chunks, negative_answer, "anchor long, r long, id long, score long")
    best = W.partitionBy("anchor", "r").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return hard.alias("h").join(near.alias("p"), ["anchor", "r"]).select(
        F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank", F.col("h.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("h.score").alias("negative_score"))


def _bands(scores: list[list[int]], positives: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, positives) of the smallest and largest score allowed; a missing positive allows none."""
    least = np.full((len(scores), positives), 1, np.int64)
    most = np.zeros((len(scores), positives), np.int64)
    for i, own in enumerate(scores):
        least[i, :len(own)] = [-(-low * s // 100) for s in own]
        most[i, :len(own)] = [high * s // 100 for s in own]
    return least, most
