"""Ranked lexical search: documents grouped by the terms they hold, best groups first.

Terms are runs of ASCII letters and digits and of any character beyond ASCII;
only A-Z are lower-cased. A term's weight falls with the number of documents
that hold it, its part of a score grows with its occurrences and falls with the
document's length (see ``impact``); all but the weight is whole-number work.

Documents are read once, whole, and kept as their counts of the items' terms.
They are then searched in blocks of ``BLOCK``: for each item, bitmaps of its
terms are put together into one presence mask per document, equal masks are one
group, and the highest score any document of a group can have follows from its
mask alone. Groups are evaluated by that bound, highest first, until no group
left can enter the item's best, which are carried from block to block of a
task. A task therefore gives at most ``top`` rows per item.

Items are taken in groups of at most about ``GROUP_BYTES`` of text, which is
what a task holds of them; each group is one pass over the documents. One item
alone may be longer.

Defined results: rows with one item_id are one item; items without id, text or
terms have no rows; null and empty texts are documents without terms and count
nowhere; documents without id count like all others but are not listed; every
row of ``docs`` is a document, so one repeated with its id is listed repeatedly;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from concord.session import cut_lineage

TOP = 10
BLOCK = 8192
GROUP_BYTES = 4_000_000
#: Parameters of a term's part of a score, in thousandths and hundredths: k1 0.8 and b 0.9.
K, B = 8, 90
#: Upper and separating ASCII characters; bytes of other characters stay as they are.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
RESULT = "item_id {}, doc_id {}, score long"


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a whole text in UTF-8, in their order."""
    return text.translate(_TABLE).split() if text else []


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one unit of a term's weight adds to the score of a document with ``length`` terms."""
    m = 100 - B + (B * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + K * m)


def presence_masks(n: int, postings: list[np.ndarray]) -> np.ndarray:
    """(n, words) bitmaps: bit t of row d is set if posting list t holds d."""
    mask = np.zeros((n, -(-len(postings) // 64)), np.uint64)
    for t, rows in enumerate(postings):
        mask[rows, t // 64] |= np.uint64(1 << t % 64)
    return mask


def _groups(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks and each row's place among them."""
    if mask.shape[1] == 1:
        found, place = np.unique(mask[:, 0], return_inverse=True)
        return found[:, None], place
    found, place = np.unique(mask.view([("", np.uint64)] * mask.shape[1])[:, 0], return_inverse=True)
    return found.view(np.uint64).reshape(len(found), -1), place


def search_block(ids: np.ndarray, postings: dict[int, tuple[np.ndarray, np.ndarray]], weight: np.ndarray,
                 item: np.ndarray, best: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
    """The ``top`` best (-score, id) of ``best`` and of one block's documents, for the terms of one item.

    ``postings`` has for each term the places of its documents and the term's impacts there.
    """
    own = [t for t in item.tolist() if t in postings]
    if not own:
        return best
    full = presence_masks(len(ids), [postings[t][0] for t in own])
    hit = np.flatnonzero(full.any(axis=1))
    masks, group = _groups(np.ascontiguousarray(full[hit]))
    most = np.array([int(weight[t]) * int(postings[t][1].max()) for t in own], np.int64)
    bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :len(own)]
    bound = bits.astype(np.int64) @ most
    order = np.argsort(-bound, kind="stable")
    by_group = np.argsort(group, kind="stable")
    size = np.bincount(group, minlength=len(masks))
    first = np.cumsum(size) - size
    done = 0
    while done < len(order):
        floor = -best[-1][0] if len(best) == top else 1
        if bound[order[done]] < floor:
            break
        # Twice as many groups each time, but none that cannot enter.
        part = order[done:2 * done + 16]
        part = part[bound[part] >= floor]
        done = 2 * done + 16
        rows = hit[np.concatenate([by_group[first[g]:first[g] + size[g]] for g in part])]
        score = _scores(rows, own, postings, weight)
        kept = score >= floor
        best = sorted(best + list(zip((-score[kept]).tolist(), ids[rows[kept]].tolist())))[:top]
    return best


def _scores(rows: np.ndarray, own: list[int], postings: dict, weight: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for t in own:
        place, value = postings[t]
        at = np.minimum(np.searchsorted(place, rows), len(place) - 1)
        there = place[at] == rows
        out[there] += weight[t] * value[at[there]]
    return out


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (item, term) with terms as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["item"], pa.array([list(dict.fromkeys(terms(t))) for t in batch["data"].to_pylist()], pa.list_(pa.binary()))],
                ["item", "terms"])

    kind = items.schema[key].dataType.simpleString()
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), F.col(text).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"item {kind}, terms array<binary>").select("item", F.explode("terms").alias("term")).distinct()


def _counted(docs: DataFrame, key: str, text: str, found: list[bytes]) -> DataFrame:
    """(id, n, terms, counts) of every document with terms: its length, and its counts of the terms ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(found)}
        for batch in batches:
            rows, length, which, counts = [], [], [], []
            for i, data in enumerate(batch["data"]):
                own = terms(data.as_py())
                if own:
                    hits = sorted((number[t], c) for t, c in Counter(own).items() if t in number)
                    rows.append(i)
                    length.append(len(own))
                    which.append(np.array([t for t, _ in hits], "<i4").tobytes())
                    counts.append(np.array([c for _, c in hits], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(rows, pa.int64())), pa.array(length, pa.int64()), pa.array(which, pa.binary()),
                 pa.array(counts, pa.binary())], ["id", "n", "terms", "counts"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("data")).where("octet_length(data) > 0")
    return rows.mapInArrow(run, f"id {kind}, n long, terms binary, counts binary")


def _document_counts(counted: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of ``size`` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), "<i4"), minlength=size)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for term, df in counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def _best_of_tasks(counted: DataFrame, item_ids: list, item_terms: list[np.ndarray], weight: np.ndarray, n_docs: int,
                   n_terms: int, top: int, block: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in item_ids]
        kind = None
        for batch in batches:
            kind = batch["id"].type
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids, which = np.array(part["id"].to_pylist(), dtype=object), part["terms"].to_pylist()
                length = part["n"].to_numpy()
                term = np.frombuffer(b"".join(which), "<i4")
                tf = np.frombuffer(b"".join(part["counts"].to_pylist()), "<i4").astype(np.int64)
                doc = np.repeat(np.arange(len(ids)), [len(w) // 4 for w in which])
                order = np.argsort(term, kind="stable")
                term, doc = term[order], doc[order]
                value = impact(tf[order], length[doc], n_docs, n_terms)
                cut = np.flatnonzero(np.diff(term)) + 1
                postings = {int(t[0]): (d, v) for t, d, v in zip(np.split(term, cut), np.split(doc, cut), np.split(value, cut)) if len(t)}
                for i, own in enumerate(item_terms):
                    best[i] = search_block(ids, postings, weight, own, best[i], top)
        rows = [(i, d, -s) for i, found in enumerate(best) for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([
                pa.array([item_ids[i] for i, _, _ in rows]), pa.array([d for _, d, _ in rows], kind),
                pa.array([s for _, _, s in rows], pa.int64())], ["item_id", "doc_id", "score"])

    return counted.where("id IS NOT NULL AND octet_length(terms) > 0").mapInArrow(run, schema)


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", top: int = TOP, block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest scores above 0 of every item, ties by doc_id."""
    wanted = cut_lineage(_item_terms(items, item_key, item_text))
    schema = RESULT.format(wanted.schema["item"].dataType.simpleString(), docs.schema[key].dataType.simpleString())
    total = wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    groups = -(-total // group_bytes)
    out = docs.sparkSession.createDataFrame([], schema)
    for g in range(groups):
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect()
        if not own:
            continue
        found = sorted({bytes(r.term) for r in own})
        number = {t: i for i, t in enumerate(found)}
        by_item = defaultdict(list)
        for r in own:
            by_item[r.item].append(number[bytes(r.term)])
        counted = cut_lineage(_counted(docs, key, text, found))
        n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weight = weights(_document_counts(counted, len(found)), n_docs)
        ids = sorted(by_item)
        out = out.union(_best_of_tasks(counted, ids, [np.array(sorted(by_item[i])) for i in ids], weight, n_docs, n_terms,
                                       top, block, schema))
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item_id").alias(item_key), "rank", F.col("doc_id").alias(key), "score")
