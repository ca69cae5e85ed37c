"""Many replicates at once: rows carry a vector of replicate weights.

Instead of one row per draw, each scored row travels once per chunk of
replicates with its weights in that chunk packed to bits, halves of bytes or
bytes. Spark partitions rows by hash blocks to draw the weights and by score
ranges to sum them; numpy only multiplies small matrices inside a task. Where the
weights of all replicates would be large, chunks are made in several passes, and
only the sums of a pass are kept: the disk needed does not grow with replicates.

Drawing n rows with replacement is a multinomial sample. Blocks are the leaves
of a binary tree over the rows' hashes. How many of a node's draws go to its
left half is a binomial number that follows from the seed and the node's place,
so a block finds its share from the row counts along its own path, a table that
Spark joins to it. No draw is shuffled, no task or driver sees all blocks, and
the sample is exact and does not depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from concord.functions.columns import hash_hex
from concord.operators.ranking import BUCKET_ROWS, bucket_spans, with_bucket
from concord.session import cut_lineage, dealt

CHUNK = 125
#: Packed weights that one pass over chunks may send; it makes one chunk at least.
PASS_BYTES = 1 << 30
ROWS_PER_BLOCK = 4096
#: Bits of the hash that blocks may use; far more than any table needs.
HASH_BITS = 48
BINS = 10


def _seed(seed: int, group: tuple, *more: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(group).encode()), *more])


#: How weights are packed: bits per weight, and the largest weight that fits.
WIDTHS = ((1, 1), (4, 15), (8, 255), (16, 65535), (32, 2**32 - 1), (64, 2**63 - 1))


def pack_weights(w: np.ndarray) -> bytes:
    """A matrix of counts, rows by replicates, behind one byte that tells the bits per count."""
    top = int(w.max(initial=0))
    bits = next(k for k, most in WIDTHS if top <= most)
    if bits == 1:
        body = np.packbits(w.astype(np.uint8), axis=1)
    elif bits == 4:
        even = np.zeros((len(w), w.shape[1] + w.shape[1] % 2), np.uint8)
        even[:, :w.shape[1]] = w
        body = even[:, ::2] << 4 | even[:, 1::2]
    else:
        body = np.ascontiguousarray(w).astype(f"<u{bits // 8}")
    return bytes([bits]) + body.tobytes()


def unpack_weights(packed: bytes, reps: int) -> np.ndarray:
    bits = packed[0]
    if bits == 1:
        flat = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, -(-reps // 8))
        return np.unpackbits(flat, axis=1)[:, :reps]
    if bits == 4:
        flat = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, -(-reps // 2))
        return np.stack([flat >> 4, flat & 15], axis=2).reshape(len(flat), -1)[:, :reps]
    return np.frombuffer(packed, f"<u{bits // 8}", offset=1).reshape(-1, reps)


def _summed(w: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of a small-typed matrix; most runs have one row or few."""
    wide = np.int32 if int(w.max(initial=0)) * len(w) < 2**31 else np.int64
    out, size = w[first].astype(wide), end - first
    for i in np.flatnonzero(size > 32):
        out[i] = w[first[i]:end[i]].sum(axis=0, dtype=wide)
    k, left = 1, np.flatnonzero((size > 1) & (size <= 32))
    while len(left):
        out[left] += w[first[left] + k]
        k += 1
        left = left[size[left] > k]
    return out


def passes(first: int, chunks: int, chunk_bytes: int) -> list[range]:
    """Chunks from ``first`` on in runs that send about ``PASS_BYTES`` each."""
    step = max(1, PASS_BYTES // max(1, chunk_bytes))
    return [range(at, min(at + step, chunks)) for at in range(first, chunks, step)]


def in_passes(parts: Sequence[range], make: Callable[[range], DataFrame]) -> DataFrame:
    """The rows that ``make`` gives for all runs of chunks.

    Runs follow one another; what one has sent is removed before the next begins.
    """
    if len(parts) == 1:
        return make(parts[0])
    out = None
    for part in parts:
        made = cut_lineage(make(part))
        out = made if out is None else out.unionByName(made)
    return out


def complete(wide: DataFrame, keep: Sequence[str], arms: Sequence[str], y: str) -> DataFrame:
    """Rows with a label of 0 or 1 and finite scores of all arms."""
    rows = wide.where(F.col(y).isin(0, 1)).select(
        *keep, F.col(y).cast("int").alias(y), *[F.col(a).cast("double").alias(a) for a in arms])
    for a in arms:
        rows = rows.where(F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return rows


def hash_blocks(rows: DataFrame, keys: Sequence[str], by: Sequence[str], size: int = ROWS_PER_BLOCK,
                count: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_blk``, and one row per block with the units along its path.

    A group of n rows has the smallest power of two of blocks that leaves about
    ``size`` rows each. ``left`` and ``right`` list for every level the units in
    both halves; the block's own bits tell which half it is in. A row is one
    unit, or as many as its ``count`` says.
    """
    units = F.col(count) if count else F.lit(1)
    by = list(by)
    one = rows if by else rows.withColumn("_all", F.lit(0))
    on = by or ["_all"]
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / F.lit(float(size))))).cast("int")
    deep = one.groupBy(*on).agg(depth.alias("_depth"), F.sum(units).alias("_total"))
    h = F.conv(F.substring(hash_hex(0, *keys), 1, HASH_BITS // 4), 16, 10).cast("long")
    marked = one.join(deep, on).withColumn("_blk", F.call_function("shiftright", h, HASH_BITS - F.col("_depth")))
    leaves = marked.groupBy(*on, "_depth", "_total", "_blk").agg(F.sum(units).alias("_n"))
    levels = F.expr("transform(sequence(1, greatest(_depth, 1)), l -> named_struct('level', l, 'node', shiftright(_blk, _depth - l)))")
    steps = leaves.select(*on, "_depth", "_total", "_blk", "_n", F.explode(levels).alias("s")).select(
        *on, "_depth", "_total", "_blk", "_n", "s.level", "s.node")
    nodes = steps.groupBy(*on, "level", "node").agg(F.sum("_n").alias("rows"))
    beside = nodes.select(*on, "level", F.col("node").bitwiseXOR(1).alias("node"), F.col("rows").alias("other"))
    both = steps.join(nodes, [*on, "level", "node"]).join(beside, [*on, "level", "node"], "left").withColumn(
        "other", F.coalesce("other", F.lit(0)))
    left = F.when(F.col("node") % 2 == 0, F.col("rows")).otherwise(F.col("other"))
    path = F.sort_array(F.collect_list(F.struct("level", left.alias("left"), (F.col("rows") + F.col("other") - left).alias("right"))))
    blocks = both.groupBy(*on, "_depth", "_total", "_blk").agg(path.alias("path"))
    # Names of their own, so that both sides can be grouped together.
    return marked.select(*rows.columns, "_blk"), blocks.select(
        *[F.col(c).alias(c) for c in [*by, "_blk"]], F.col("_depth").alias("depth"), F.col("_total").alias("total"),
        F.col("path.left").alias("left"), F.col("path.right").alias("right"))


def block_share(block: int, depth: int, total: int, left: Sequence[int], right: Sequence[int], n: int, *seed) -> np.ndarray:
    """How many of ``total`` draws each of ``n`` replicates makes in one block, the same in every task."""
    draws = np.full(n, total, np.int64)
    for level in range(depth):
        # The node above the step: its leading bits say where it stands.
        rng = _seed(*seed, 1 + level, block >> (depth - level))
        to_left = rng.binomial(draws, left[level] / (left[level] + right[level]))
        draws = to_left if not block >> (depth - 1 - level) & 1 else draws - to_left
    return draws


def _plain(group) -> tuple:
    return tuple(g.item() if hasattr(g, "item") else g for g in group)


def _schema(df: DataFrame, by: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in by) + (
        "arm string, chunk int, _range long, score binary, y binary, copies binary, w binary")


def _ranged(rows: DataFrame, by: Sequence[str], sides: Sequence[tuple[str, Sequence[str]]], size: int) -> DataFrame:
    """Rows with the score range of every arm (or of both arms of a pair) as ``_r_<side>_<arm>``.

    Ranges are found and joined here, before weights make the rows long.
    """
    long = F.explode(F.array(*[F.struct(F.lit(name).alias("arm"), F.col(a).alias("score")) for name, own in sides for a in own]))
    # Read several times from here on, so written once.
    rows = cut_lineage(rows)
    first, second, limit = bucket_spans(rows.select(*by, long.alias("_s")).select(*by, "_s.*"), "score", [*by, "arm"], size)
    first, second = cut_lineage(first), cut_lineage(second)
    for i, (name, own) in enumerate(sides):
        spans = tuple(t.where(F.col("arm") == name).drop("arm") for t in (first, second))
        if not by:
            spans = tuple(t.withColumn("_all", F.lit(0)) for t in spans)
        for j, a in enumerate(own):
            rows = with_bucket(rows, (*spans, limit), a, by, f"_r_{i}_{j}")
    return cut_lineage(rows)


class _Layout:
    """How the rows of a block fall to score ranges and to runs of equal score and label, the same for all chunks."""

    def __init__(self, ranges: np.ndarray, score: np.ndarray, label: np.ndarray):
        self.order = np.lexsort((label, score, ranges))
        r, s, y = ranges[self.order], score[self.order], label[self.order]
        self.first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (y[1:] != y[:-1])][:len(r)])
        self.end = np.r_[self.first[1:], len(r)].astype(np.int64)[:len(self.first)]
        own = r[self.first]
        self.cut = np.r_[np.flatnonzero(np.diff(own, prepend=-1)), len(own)]
        parts = list(zip(self.cut[:-1], self.cut[1:]))
        self.fixed = [(int(own[i]), s[self.first[i:j]].astype("<f8").tobytes(), y[self.first[i:j]].astype(np.uint8).tobytes(),
                       (self.end - self.first)[i:j].astype("<u4").tobytes()) for i, j in parts]

    def packed(self, by: Sequence[str], key, arm: str, chunk: int, w: np.ndarray) -> pd.DataFrame:
        """One row for every score range of a block, with its scores, labels, copies and weights as packed arrays."""
        merged = _summed(w[self.order], self.first, self.end)
        made = [(*fixed, pack_weights(merged[i:j])) for fixed, i, j in zip(self.fixed, self.cut[:-1], self.cut[1:])]
        out = pd.DataFrame(made, columns=["_range", "score", "y", "copies", "w"])
        out.insert(0, "chunk", chunk)
        out.insert(0, "arm", arm)
        for i, c in enumerate(by):
            out.insert(i, c, key[i])
        return out


def _narrow(w: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them, row after row."""
    top = int(w.max(initial=0))
    return np.ascontiguousarray(w.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.int64, order="K"))


def bootstrap_weights(wide: DataFrame, item: str, arms: Sequence[str], n_boot: int, seed: int,
                      by: Sequence[str] = (), y: str = "gold", first: int = 0,
                      range_rows: int = BUCKET_ROWS) -> DataFrame:
    """Packed rows (by, arm, chunk, _range, score, y, copies, w) of a bootstrap.

    ``first`` leaves out the chunks before it: later ones continue the same series of draws.
    """
    by, arms = list(by), list(arms)
    rows = _ranged(complete(wide, [*by, item], arms, y), by, [(a, [a]) for a in arms], range_rows)
    return _drawn_chunks(*hash_blocks(rows, [item], by), item, arms, n_boot, seed, by, y, range(first, -(-n_boot // CHUNK)))


def bootstrap_replicates(wide: DataFrame, item: str, arms: Sequence[str], n_boot: int, seed: int, by: Sequence[str] = (),
                         y: str = "gold", first: int = 0, calibration: bool = True) -> DataFrame:
    """``weighted_metrics`` of ``bootstrap_weights``, in as many passes as the weights' size asks for."""
    by, arms = list(by), list(arms)
    rows = _ranged(complete(wide, [*by, item], arms, y), by, [(a, [a]) for a in arms], BUCKET_ROWS)
    # Score, label and copies stand beside the weights of half a byte.
    parts = passes(first, -(-n_boot // CHUNK), rows.count() * len(arms) * (13 + CHUNK // 2))
    tables = hash_blocks(rows, [item], by)
    if len(parts) > 1:
        tables = tuple(cut_lineage(t) for t in tables)
    return in_passes(parts, lambda part: weighted_metrics(
        _drawn_chunks(*tables, item, arms, n_boot, seed, by, y, part), by, n_boot, calibration=calibration))


def _drawn_chunks(spread: DataFrame, blocks: DataFrame, item: str, arms: list[str], n_boot: int, seed: int, by: list[str],
                  y: str, part: range) -> DataFrame:
    """The packed rows of some chunks, from the tables of ``hash_blocks``."""

    def run(key, pdf: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        group, block = _plain(key[:-1]), int(key[-1])
        pdf, p = pdf.sort_values(item), path.iloc[0]
        even = np.full(len(pdf), 1.0 / len(pdf))
        label, out = pdf[y].to_numpy(), []
        laid = [_Layout(pdf[f"_r_{i}_0"].to_numpy(), pdf[a].to_numpy(), label) for i, a in enumerate(arms)]
        for chunk in part:
            n = min(CHUNK, n_boot - chunk * CHUNK)
            share = block_share(block, int(p["depth"]), int(p["total"]), p["left"], p["right"], n, seed, group, chunk)
            w = _narrow(_seed(seed, group, chunk, 0, block).multinomial(share, even).T)
            out += [own.packed(by, key, a, chunk, w) for own, a in zip(laid, arms)]
        return pd.concat(out, ignore_index=True)

    keys = [*by, "_blk"]
    return dealt(spread, *keys).groupBy(*keys).cogroup(dealt(blocks, *keys).groupBy(*keys)).applyInPandas(run, _schema(spread, by))


#: Draws that one md5 gives, coin flips that one gives, and draws that a task holds before it deals them out.
DRAWS_PER_HASH = 4
FLIPS_PER_HASH = 32
HELD_DRAWS = 4_000_000


def _hashes(seed: int, blocks: int, unit: str, first: int = 0) -> Column:
    """The md5 digests of the blocks of draws of a unit from the first on, one after the other."""
    return F.array_join(F.transform(F.sequence(F.lit(first), F.lit(blocks - 1)), lambda b: hash_hex(seed, b, F.col(unit))), "")


def idx_blocks(idx: DataFrame, block: int) -> DataFrame:
    return idx.withColumn("_blk", F.floor(F.col("idx") / block).cast("long"))


def draw_codes(idx: DataFrame, n_boot: int, seed: int, by: Sequence[str], block: int, first: int = 0) -> DataFrame:
    """(by, _blk, code): for every block of ``idx`` the draws that hit it, four bytes each (replicate and place).

    ``first``, a multiple of ``DRAWS_PER_HASH``, leaves out the replicates before it; codes count from there.
    """
    by = list(by)
    kinds = dict(idx.dtypes)
    keys = [*by, "_blk"]
    made = idx.select(*by, F.col("n").alias("_n"), _hashes(seed, -(-n_boot // DRAWS_PER_HASH), "idx", first // DRAWS_PER_HASH).alias("_h"))
    n_boot -= first

    def dealt_out(held: dict[tuple, list[np.ndarray]]) -> pd.DataFrame:
        out = []
        for group, parts in held.items():
            code = np.concatenate(parts)
            code = code[np.argsort(code[:, 0], kind="stable")]
            cut = np.flatnonzero(np.diff(code[:, 0], prepend=-1))
            for part in np.split(code, cut[1:]) if len(code) else []:
                out.append((*group, int(part[0, 0]), part[:, 1].astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=[*keys, "code"])

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        size = 0
        for pdf in batches:
            for group, part in pdf.groupby(by, sort=False) if by else [((), pdf)]:
                for at in range(0, len(part), step := max(1, HELD_DRAWS // n_boot)):
                    few = part.iloc[at:at + step]
                    drawn = np.frombuffer(bytes.fromhex("".join(few["_h"])), ">u4").reshape(len(few), -1)[:, :n_boot].astype(np.int64)
                    drawn %= few["_n"].to_numpy(np.int64)[:, None]
                    code = np.arange(n_boot) * block + drawn % block
                    held.setdefault(group if isinstance(group, tuple) else (group,), []).append(
                        np.stack([drawn.ravel() // block, code.ravel()], axis=1))
                    size += drawn.size
                    if size >= HELD_DRAWS:
                        yield dealt_out(held)
                        held, size = {}, 0
        yield dealt_out(held)

    # Groups that are null fall away here as in a join.
    known = made.where(" AND ".join([f"`{c}` IS NOT NULL" for c in by] or ["true"]))
    return known.mapInPandas(hits, "".join(f"`{c}` {kinds[c]}, " for c in by) + "_blk long, code binary")


def coded_counts(found: pd.DataFrame, n_boot: int, rows: int, block: int) -> np.ndarray:
    """Replicates by rows of a block: how often each row was drawn."""
    code = np.frombuffer(b"".join(found["code"]), "<u4")
    return np.bincount(code, minlength=n_boot * block).reshape(n_boot, block)[:, :rows]


def drawn_weights(idx: DataFrame, arms: Sequence[str], n_boot: int, seed: int, by: Sequence[str] = (), y: str = "gold",
                  range_rows: int = BUCKET_ROWS, block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The packed rows of ``bootstrap_weights`` for draws from md5, which plain SQL can repeat.

    ``idx`` are complete rows with a dense ``idx`` from 0 and their number ``n``
    per group. Row i makes draw i of every replicate; a draw travels as four
    bytes to the block of the row it hits.
    """
    by, arms = list(by), list(arms)
    rows = _ranged(idx, by, [(a, [a]) for a in arms], range_rows)
    codes = draw_codes(rows, n_boot, seed, by, block)
    rows = idx_blocks(rows, block)
    keys = [*by, "_blk"]

    def run(key, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or found.empty:
            return pd.DataFrame(columns=[*by, "arm", "chunk", "_range", "score", "y", "copies", "w"])
        pdf = pdf.sort_values("idx")
        counts = coded_counts(found, n_boot, len(pdf), block)
        label, out = pdf[y].to_numpy(), []
        for i, a in enumerate(arms):
            own = _Layout(pdf[f"_r_{i}_0"].to_numpy(), pdf[a].to_numpy(), label)
            out += [own.packed(by, key, a, c, _narrow(counts[c * CHUNK:(c + 1) * CHUNK].T)) for c in range(-(-n_boot // CHUNK))]
        return pd.concat(out, ignore_index=True)

    return dealt(rows.drop("n"), *keys).groupBy(*keys).cogroup(dealt(codes, *keys).groupBy(*keys)).applyInPandas(run, _schema(rows, by))


#: Most and fewest rows of a block of ``block_weights``.
WIDE_BLOCK, NARROW_BLOCK = 65536, 1024


def seed_picks(n_boot: int, seed: int, most: int) -> np.ndarray:
    """Replicates by places: the md5 number that tells which seed is drawn there."""
    return np.array([[int(hashlib.md5(f"{seed + 1}:{r}:{j}".encode()).hexdigest()[:8], 16) for j in range(most)]
                     for r in range(n_boot)], np.int64).reshape(n_boot, most)


class _Seeds:
    """Every row's scores by seed for one arm, from which a replicate's mean scores follow."""

    def __init__(self, scores: Sequence, size: np.ndarray):
        """``size`` is how many seeds each row draws from and draws."""
        self.size, held = size, np.array([-1 if x is None else len(x) for x in scores])
        held[held == 0] = -1
        if ((held >= 0) & (held < size)).any():
            raise ValueError("an arm has fewer seeds of an item than the first arm")
        self.at = np.r_[0, np.cumsum(np.maximum(held, 0))][:-1]
        self.known = (held >= 0) & (size > 0)
        found = [np.asarray(x, np.float64) for x in scores if x is not None]
        self.flat = np.r_[np.concatenate(found) if found else np.empty(0), np.nan]

    def means(self, rows: np.ndarray, picks: np.ndarray) -> np.ndarray:
        """Mean score of some rows over the seeds drawn (one list for all, or one a row), to 12 digits; NaN where there is none."""
        picks = np.broadcast_to(picks, (len(rows), picks.shape[-1]))
        out = np.full(len(rows), np.nan)
        for size in np.unique(self.size[rows]):
            i = np.flatnonzero((self.size[rows] == size) & self.known[rows])
            total = np.zeros(len(i))
            for j in range(size):
                total += self.flat[self.at[rows[i]] + picks[i, j] % size]
            out[i] = total / max(size, 1)
        return np.where(np.abs(out) < 1000, np.round(out, 12), out)


def _range_edges(idx: DataFrame, arms: Sequence[str], picks: np.ndarray, by: Sequence[str], y: str, rows: int) -> DataFrame:
    """(by, edges): for each arm the scores at which its ranges begin, about ``rows`` rows in each.

    Row i counts with its score in one replicate, each in turn, so no replicate
    can have more than its number times ``rows`` in a range, and on like seeds about ``rows``.
    """
    by, n_boot = list(by), len(picks)
    kinds = dict(idx.dtypes)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            size = np.array([0 if x is None else len(x) for x in pdf[arms[0]]], np.int64)
            out, turn = pdf[by].copy(), picks[pdf["idx"].to_numpy(np.int64) % n_boot]
            for i, a in enumerate(arms):
                out[f"_s{i}"] = _Seeds(pdf[a].tolist(), size).means(np.arange(len(pdf)), turn)
            yield out

    scores = idx.where(F.col(y).isin(0, 1)).select(*by, "idx", *arms).mapInPandas(
        one, "".join(f"`{c}` {kinds[c]}, " for c in by) + ", ".join(f"_s{i} double" for i in range(len(arms))))
    largest = idx.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    steps = max(1, -(-largest // rows))
    shares = [k / steps for k in range(1, steps)] or [0.5]
    cuts = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[
        F.percentile_approx(F.when(~F.isnan(f"_s{i}"), F.col(f"_s{i}")), shares, max(10000, 20 * steps)).alias(f"_e{i}") for i in range(len(arms))])
    # A smaller group takes fewer of the edges.
    few = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(float(rows)))).cast("int")

    def chosen(edges: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), few), lambda k: F.get(edges, (F.floor(k * steps / few) - 1).cast("int")))
        return F.coalesce(F.array_distinct(F.array_compact(own)), F.array().cast("array<double>"))

    return cuts.select(*by, F.array(*[chosen(F.col(f"_e{i}")) for i in range(len(arms))]).alias("_edges"))


def block_weights(idx: DataFrame, arms: Sequence[str], n_boot: int, seed: int, by: Sequence[str] = (), y: str = "gold",
                  range_rows: int = 4 * BUCKET_ROWS, block: int | None = None) -> DataFrame:
    """The packed rows of ``bootstrap_weights``, one chunk a replicate, where replicates also draw the seeds of a score.

    ``idx`` has a dense ``idx`` from 0 and the number ``n`` per group; each arm
    is an array of scores by seed. Rows and seeds are drawn by md5. A
    replicate's scores are made in the block that has its draws; what leaves the
    block are its distinct scores with their counts, for every score range.
    """
    return _block_draws(cut_lineage(idx), arms, n_boot, seed, by, y, range_rows, block)(range(n_boot))


def block_replicates(idx: DataFrame, arms: Sequence[str], n_boot: int, seed: int, by: Sequence[str] = (), y: str = "gold") -> DataFrame:
    """``weighted_metrics`` of ``block_weights``, in as many passes as the weights' size asks for."""
    idx = cut_lineage(idx)
    # A draw has four bytes; about two rows of three are drawn, with 14 bytes for the score and count of each arm.
    parts = passes(0, -(-n_boot // DRAWS_PER_HASH), idx.count() * DRAWS_PER_HASH * (4 + 9 * len(arms)))
    reps = [range(p.start * DRAWS_PER_HASH, min(n_boot, p.stop * DRAWS_PER_HASH)) for p in parts]
    drawn = _block_draws(idx, arms, n_boot, seed, by, y, 4 * BUCKET_ROWS, None)
    return in_passes(reps, lambda part: weighted_metrics(drawn(part), by, n_boot, chunk_size=1))


def _block_draws(idx: DataFrame, arms: Sequence[str], n_boot: int, seed: int, by: Sequence[str], y: str, range_rows: int,
                 block: int | None) -> Callable[[range], DataFrame]:
    """The packed rows of a run of replicates that begins at a multiple of ``DRAWS_PER_HASH``; ``idx`` should be stored."""
    by, arms = list(by), list(arms)
    block = block or max(NARROW_BLOCK, min(WIDE_BLOCK, HELD_DRAWS // n_boot))
    most = idx.agg(F.max(F.size(arms[0]))).first()[0] or 0
    picks = seed_picks(n_boot, seed, max(int(most), 0))
    edges = cut_lineage(_range_edges(idx, arms, picks, by, y, range_rows))
    keys = [*by, "_blk"]
    rows = idx_blocks(idx, block).select(*keys, "idx", F.when(F.col(y).isin(0, 1), F.col(y).cast("int")).alias(y), *arms)
    # Groups are few, and a block needs the edges of its own.
    rows = rows.join(F.broadcast(edges), by) if by else rows.crossJoin(F.broadcast(edges))

    def drawn(part: range) -> DataFrame:
        def run(key, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame(columns=[*by, "arm", "chunk", "_range", "score", "y", "copies", "w"])]
            if pdf.empty or found.empty:
                return out[0]
            pdf = pdf.sort_values("idx").reset_index(drop=True)
            counts = coded_counts(found, len(part), len(pdf), block)
            label = pdf[y].to_numpy(np.float64)
            size = np.array([0 if x is None else len(x) for x in pdf[arms[0]]], np.int64)
            for i, a in enumerate(arms):
                own, cuts = _Seeds(pdf[a].tolist(), size), np.asarray(pdf["_edges"].iloc[0][i], np.float64)
                for r, count in zip(part, counts):
                    hit = np.flatnonzero((count > 0) & ~np.isnan(label))
                    score = own.means(hit, picks[r])
                    hit, score = hit[~np.isnan(score)], score[~np.isnan(score)]
                    if len(hit):
                        laid = _Layout(np.searchsorted(cuts, score, side="right"), score, label[hit].astype(np.int64))
                        out.append(laid.packed(by, key, a, r, _narrow(count[hit][:, None])))
            return pd.concat(out[1:] or out, ignore_index=True)

        codes = draw_codes(idx, part.stop, seed, by, block, part.start)
        return dealt(rows, *keys).groupBy(*keys).cogroup(dealt(codes, *keys).groupBy(*keys)).applyInPandas(run, _schema(rows, by))

    return drawn


def permutation_weights(wide: DataFrame, item: str, pairs: Sequence[tuple[str, str]], n_perm: int, seed: int,
                        by: Sequence[str] = (), y: str = "gold",
                        range_rows: int = BUCKET_ROWS, sampler: str = "random") -> DataFrame:
    """Packed rows of a swap test: arm names are ``a|b``; replicate 0 swaps nothing.

    A swapped row counts under the other arm's score, so swaps are weights too.
    The weights are those of the first side; the second side has the rest of
    each row's copies. ``sampler`` is ``random`` or ``md5``.
    """
    by = list(by)
    spread = hash_blocks(_paired_ranges(wide, item, pairs, by, y, range_rows), [item], by)[0]
    return _swapped_chunks(spread, item, pairs, n_perm, seed, by, y, sampler, range(-(-(n_perm + 1) // CHUNK)))


def permutation_replicates(wide: DataFrame, item: str, pairs: Sequence[tuple[str, str]], n_perm: int, seed: int,
                           by: Sequence[str] = (), y: str = "gold", sampler: str = "random") -> DataFrame:
    """``weighted_metrics`` of both sides of ``permutation_weights``, in as many passes as the weights' size asks for."""
    by, total = list(by), n_perm + 1
    rows = _paired_ranges(wide, item, pairs, by, y, BUCKET_ROWS)
    # A row stands under both scores of a pair, with one bit a replicate, or four where rows of equal scores meet.
    parts = passes(0, -(-total // CHUNK), rows.count() * 2 * len(pairs) * (13 + CHUNK // 4))
    spread = hash_blocks(rows, [item], by)[0]
    if len(parts) > 1:
        spread = cut_lineage(spread)
    return in_passes(parts, lambda part: weighted_metrics(
        _swapped_chunks(spread, item, pairs, n_perm, seed, by, y, sampler, part), by, total, sides=2, calibration=False))


def _paired_ranges(wide: DataFrame, item: str, pairs: Sequence[tuple[str, str]], by: list[str], y: str, range_rows: int) -> DataFrame:
    arms = sorted({x for pair in pairs for x in pair})
    return _ranged(complete(wide, [*by, item], arms, y), by, [(f"{a}|{b}", (a, b)) for a, b in pairs], range_rows)


def _swapped_chunks(spread: DataFrame, item: str, pairs: Sequence[tuple[str, str]], n_perm: int, seed: int, by: list[str],
                    y: str, sampler: str, part: range) -> DataFrame:
    """The packed rows of some chunks, from the rows of ``hash_blocks``."""
    total = n_perm + 1
    spread = _with_flips(spread, item, n_perm, seed, sampler)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        group, block = _plain(key[:-1]), int(key[-1])
        pdf = pdf.sort_values(item)
        label = np.tile(pdf[y].to_numpy(), 2)
        laid = [_Layout(np.r_[pdf[f"_r_{i}_0"].to_numpy(), pdf[f"_r_{i}_1"].to_numpy()],
                        np.r_[pdf[a].to_numpy(), pdf[b].to_numpy()], label) for i, (a, b) in enumerate(pairs)]
        flips, out = _flips(pdf), []
        for chunk in part:
            swap = _swaps(seed, group, chunk, block, len(pdf), min(CHUNK, total - chunk * CHUNK), flips)
            w = np.r_[swap ^ 1, swap]
            out += [own.packed(by, key, f"{a}|{b}", chunk, w) for own, (a, b) in zip(laid, pairs)]
        return pd.concat(out, ignore_index=True)

    return dealt(spread, *by, "_blk").groupBy(*by, "_blk").applyInPandas(run, _schema(spread, by))


def _with_flips(spread: DataFrame, item: str, n_perm: int, seed: int, sampler: str) -> DataFrame:
    return spread if sampler == "random" else spread.withColumn("_flips", _hashes(seed, -(-n_perm // FLIPS_PER_HASH), item))


def _flips(pdf: pd.DataFrame) -> np.ndarray | None:
    """The hex digits of the rows' md5 flips, where they have any; a digit of 8 or more swaps."""
    if "_flips" not in pdf:
        return None
    return np.frombuffer("".join(pdf["_flips"]).encode("ascii"), np.uint8).reshape(len(pdf), -1)


def _swaps(seed: int, group: tuple, chunk: int, block: int, rows: int, reps: int, flips: np.ndarray | None = None) -> np.ndarray:
    if flips is not None:
        # Replicate 0 is the one without a swap, so replicate r has digit r - 1.
        swap = np.zeros((rows, reps), np.uint8)
        start = max(0, chunk * CHUNK - 1)
        swap[:, int(chunk == 0):] = flips[:, start:chunk * CHUNK + reps - 1] >= ord("8")
        return swap
    swap = _seed(seed, group, chunk, block).integers(0, 2, size=(rows, reps), dtype=np.uint8)
    if chunk == 0:
        swap[:, 0] = 0
    return swap


def mixed_swaps(wide: DataFrame, item: str, arms: Sequence[str], n_perm: int, seed: int, by: Sequence[str] = (),
                y: str = "gold", sampler: str = "random") -> DataFrame:
    """(by, rep) of the replicates of ``permutation_weights`` in which some rows of the group swap and some do not."""
    by, total = list(by), n_perm + 1
    spread, _ = hash_blocks(complete(wide, [*by, item], sorted(set(arms)), y).select(*by, item), [item], by)
    spread = _with_flips(spread, item, n_perm, seed, sampler)
    kinds = dict(spread.dtypes)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        flips, out = _flips(pdf), []
        for chunk in range(-(-total // CHUNK)):
            n = min(CHUNK, total - chunk * CHUNK)
            swap = _swaps(seed, _plain(key[:-1]), chunk, int(key[-1]), len(pdf), n, flips)
            out.append(pd.DataFrame({"rep": chunk * CHUNK + np.arange(n), "low": swap.min(axis=0), "high": swap.max(axis=0)}))
        made = pd.concat(out, ignore_index=True).astype("int32")
        for i, c in enumerate(by):
            made.insert(i, c, key[i])
        return made

    head = "".join(f"`{c}` {kinds[c]}, " for c in by)
    ends = dealt(spread, *by, "_blk").groupBy(*by, "_blk").applyInPandas(run, head + "rep int, low int, high int")
    return ends.groupBy(*by, "rep").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select(*by, "rep")


RANKING = ["pos", "neg", "losses", "area"]
CALIBRATION = ["sq", *[f"{k}{i}" for k in ("bn", "bp", "by") for i in range(BINS)]]
#: Replicates that a sweep follows at a time, so that its vectors stay in the processor's cache.
REPS_PER_STEP = 8


class _Part:
    """Scores, labels and weights of one score range, highest score first."""

    def __init__(self, pdf: pd.DataFrame, n: int):
        join = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
        self.score, self.y, self.copies = join("score", "<f8"), join("y", np.uint8), join("copies", "<u4")
        self.w = np.concatenate([unpack_weights(w, n) for w in pdf["w"]])

    def side(self, k: int) -> np.ndarray:
        return self.w if k == 0 else self.copies[:, None].astype(np.int64) - self.w


def _sweep(part: _Part, n: int, above: Sequence[tuple[np.ndarray, np.ndarray]], calibration: bool) -> list[np.ndarray]:
    """All sums of one score range for n replicates and every side, one row per replicate.

    ``above`` has the class weights above the range, by side. A positive row
    loses to the negatives over it, and to half of those beside it. Sums run
    along the rows of one class, so positives look up the negatives' sums at
    their own places; equal scores look up the end of their run.
    """
    order = np.argsort(-part.score, kind="stable")
    up = part.y[order] == 1
    pos, neg = order[up], order[~up]
    own, other = -part.score[pos], -part.score[neg]
    upto, over = np.searchsorted(other, own, side="right"), np.searchsorted(other, own, side="left")
    last = np.searchsorted(own, own, side="right") - 1
    tied, beside = bool((last != np.arange(len(own))).any()), bool((upto != over).any())
    w_pos, w_neg = np.ascontiguousarray(part.w[pos].T), np.ascontiguousarray(part.w[neg].T)
    copies = [part.copies[at].astype(np.float64) for at in (pos, neg)]
    out = [np.zeros((n, len(RANKING))) for _ in above]
    for at in range(0, n, REPS_PER_STEP):
        step = slice(at, at + REPS_PER_STEP)
        p0, q0 = w_pos[step].astype(np.float64), w_neg[step].astype(np.float64)
        for side, (above_pos, above_neg) in enumerate(above):
            p, q = (p0, q0) if side == 0 else (copies[0] - p0, copies[1] - q0)
            run_p = np.cumsum(p, axis=1)
            run_q = np.zeros((len(q), len(neg) + 1))
            np.cumsum(q, axis=1, out=run_q[:, 1:])
            sums = out[side][step]
            sums[:, 0], sums[:, 1] = p.sum(axis=1), run_q[:, -1]
            if not len(pos):
                continue
            fp = above_neg[step, None]
            if tied:
                run_p = np.take(run_p, last, axis=1)
            here = np.take(run_q, upto, axis=1)
            sums[:, 2] = np.einsum("ij,ij->i", p, here) + sums[:, 0] * fp[:, 0]
            if beside:
                sums[:, 2] -= 0.5 * np.einsum("ij,ij->i", p, here - np.take(run_q, over, axis=1))
            run_p += above_pos[step, None]
            here += fp
            here += run_p
            np.maximum(here, 1.0, out=here)
            np.divide(run_p, here, out=here)
            sums[:, 3] = np.einsum("ij,ij->i", p, here)
    if not calibration:
        return out
    p = np.clip(part.score, 0.0, 1.0)
    cell = np.minimum((p * BINS).astype(int), BINS - 1)
    met = np.unique(cell)
    hot = (cell[:, None] == met).astype(np.float64)
    columns = np.column_stack([(p - part.y) ** 2, hot, hot * p[:, None], hot * part.y[:, None]])
    places = np.r_[0, [1 + k * BINS + b for k in range(3) for b in met]].astype(int)
    for side in range(len(above)):
        w, more = np.ascontiguousarray(part.side(side).T), np.zeros((n, len(CALIBRATION)))
        for at in range(0, n, REPS_PER_STEP):
            more[at:at + REPS_PER_STEP, places] = w[at:at + REPS_PER_STEP].astype(np.float64) @ columns
        out[side] = np.column_stack([out[side], more])
    return out


def weighted_metrics(weights: DataFrame, by: Sequence[str], reps: int, sides: int = 1, calibration: bool = True,
                     chunk_size: int = CHUNK) -> DataFrame:
    """AUC, AP, Brier and ECE for every (by, arm, side, rep) of a weight table.

    Brier and ECE come only with ``calibration``. A chunk has ``chunk_size`` replicates.
    Side 0 has the given weights, side 1 what they leave of each row's copies.

    Groups come in score ranges that follow their data: a first pass adds up the
    class weights of each range, a second continues each range from the sums
    above it. Both read the same shuffle.
    """
    by = list(by)
    keys = [*by, "arm", "chunk"]
    stats = RANKING + (CALIBRATION if calibration else [])
    types = dict(weights.dtypes)
    head = "".join(f"`{c}` {types[c]}, " for c in by) + "arm string, "

    def framed(key, chunk: int, per_side: list[np.ndarray]) -> pd.DataFrame:
        out = pd.concat([pd.DataFrame(sums, columns=stats).assign(
            side=side, rep=chunk * chunk_size + np.arange(len(sums))) for side, sums in enumerate(per_side)])
        for i, c in enumerate([*by, "arm"]):
            out[c] = key[i]
        return out[[*by, "arm", "side", "rep", *stats]]

    def size(chunk: int) -> int:
        return min(chunk_size, reps - chunk * chunk_size)

    schema = head + "side int, rep int, " + ", ".join(f"`{s}` double" for s in stats)

    def totals(key, pdf):
        part = _Part(pdf, size(int(key[-2])))
        row = dict(zip([*keys, "_range"], key))
        for k in range(sides):
            w = part.side(k)
            row[f"p{k}"], row[f"q{k}"] = (
                w[part.y == c].sum(axis=0, dtype=np.int64).astype(np.float64).tobytes() for c in (1, 0))
        return pd.DataFrame([row])

    sums_of = [f"{c}{k}" for k in range(sides) for c in "pq"]
    keyed = head + "chunk int, _range long, " + ", ".join(f"{c} binary" for c in sums_of)

    def above(key, pdf):
        pdf = pdf.sort_values("_range", ascending=False).reset_index(drop=True)
        for c in sums_of:
            m = np.stack([np.frombuffer(b) for b in pdf[c]])
            pdf[c] = [row.tobytes() for row in np.cumsum(m, axis=0) - m]
        return pdf

    weights = dealt(weights, *keys, "_range")
    sums = weights.groupBy(*keys, "_range").applyInPandas(totals, keyed)
    offsets = sums.groupBy(*keys).applyInPandas(above, keyed)

    def part(key, left, right):
        n = size(int(key[-2]))
        if left.empty:
            return pd.DataFrame(columns=[*by, "arm", "side", "rep", *stats])
        own = _Part(left, n)
        return framed(key, int(key[-2]), _sweep(own, n, [
            tuple(np.frombuffer(right[f"{c}{k}"].iloc[0]) for c in "pq") for k in range(sides)], calibration))

    parts = weights.groupBy(*keys, "_range").cogroup(dealt(offsets, *keys, "_range").groupBy(*keys, "_range")).applyInPandas(part, schema)
    summed = parts.groupBy(*by, "arm", "side", "rep").agg(*[F.sum(s).alias(s) for s in stats])
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    out = [
        *by, "arm", "side", "rep",
        F.when(both, F.try_divide(F.col("pos") * F.col("neg") - F.col("losses"), F.col("pos") * F.col("neg"))).alias("auc"),
        F.when(both, F.try_divide(F.col("area"), F.col("pos"))).alias("ap"),
    ]
    if calibration:
        n = F.col("pos") + F.col("neg")
        gaps = F.array(*[F.abs(F.col(f"bp{i}") - F.col(f"by{i}")) for i in range(BINS)])
        out += [
            F.try_divide(F.col("sq"), n).alias("brier"),
            F.try_divide(F.aggregate(gaps, F.lit(0.0), lambda t, g: t + g), n).alias("ece"),
        ]
    return summed.select(*out)
