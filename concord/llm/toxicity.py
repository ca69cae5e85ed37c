"""Toxicity by a support vector machine on a gap-tolerant subsequence kernel.

Two strings are alike if they share subsequences of three letters within a span
of five; each gap costs a factor. Inserted characters and gaps therefore lower
a match but do not end it. Landmark strings from labelled documents give every
string a short vector (Nystroem), a linear machine is trained on sentences, and
a document takes its highest sentences.

Defined results: null and empty texts get the score of a text without any
match; texts of any length are read whole; words of more than ``BLOCK`` letters
are compared in consecutive blocks of that many; a label given twice counts as
toxic if either is; of an id with several texts the
smallest is learned from; without labels of both classes the score is the share of
toxic labels (0 without any). Every input row yields one row, and its other
columns are left alone.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from concord.llm.text import steps
from concord.session import small_table

LETTERS = 40
SPAN = 5
DECAY = 0.6
BLOCK = 24
#: Kernel values below this count as zero, which lets most words be passed over early.
FLOOR = 0.35
STEP_CHARS = 500_000
#: Characters of distinct words compared in one go, and the most numbers that go holds of one kind.
WORD_CHARS, CELLS = 250_000, 2_000_000
PATTERNS = tuple((a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b))
#: Bytes of words and kernel rows that a worker remembers, about, before it starts anew.
KEPT_BYTES = 24_000_000
#: Three or more single characters set apart by spaces.
SPACED = re.compile(r"(?<!\S)\S(?: \S(?!\S)){2,}")
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Class of each character: 0 a gap, 1-26 the letters a-z, 27-38 other letters, 39 white space."""
    table = np.zeros(0x3000, np.uint8)
    for i in range(len(table)):
        ch = LEET.get(chr(i), chr(i).lower()[:1])
        if chr(i).isspace():
            table[i] = 39
        elif "a" <= ch <= "z":
            table[i] = ord(ch) - 96
        elif ch.isalpha():
            table[i] = 27 + ord(ch) % 12
    return table


def _encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character classes, and where words start: each at the white space before it, which marks its beginning."""
    points = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _codes()
    code = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 27 + points % 12).astype(np.uint8)
    return code, code == 39


def _blocks(start: np.ndarray) -> np.ndarray:
    """Starts of words, with words longer than BLOCK cut into blocks."""
    at = np.flatnonzero(start)
    length = np.diff(np.append(at, len(start)))
    if not (length > BLOCK).any():
        return at
    pieces = -(-length // BLOCK)
    first = np.cumsum(pieces) - pieces
    return np.repeat(at, pieces) + BLOCK * (np.arange(pieces.sum()) - np.repeat(first, pieces))


@dataclass(frozen=True)
class _Tables:
    values: np.ndarray  # (letters^3, landmarks): normalised landmark features
    bound: np.ndarray  # their largest value over the landmarks


def _features(word: str) -> dict[int, float]:
    code, out = _encode(word)[0].astype(int), Counter()
    for a, b, w in PATTERNS:
        for i in range(len(code) - b):
            x, y, z = code[i], code[i + a], code[i + b]
            if x and y and z:
                out[(x * LETTERS + y) * LETTERS + z] += w
    return out


@lru_cache(maxsize=1)
def _tables(landmarks: tuple[str, ...]) -> _Tables:
    values = np.zeros((LETTERS**3, len(landmarks)), np.float32)
    for j, word in enumerate(landmarks):
        found = _features(word)
        norm = np.sqrt(sum(v * v for v in found.values())) or 1.0
        for f, v in found.items():
            values[f, j] = v / norm
    return _Tables(values, values.max(axis=1, initial=0.0))


def _norms(word: np.ndarray, feature: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """Length of each word's feature vector: the weights of a feature are added up before they are squared."""
    both = word.astype(np.int64) * LETTERS**3 + feature
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.diff(both, prepend=-1))
    summed = np.add.reduceat(weight[order].astype(float), first)
    return np.sqrt(np.bincount(both[first] // LETTERS**3, summed**2, count))


def similar_words(text: str, landmarks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Start and kernel row of every word whose kernel with some landmark reaches FLOOR.

    Words are first passed over by a bound: a landmark's largest value for each
    feature, over a length that counts repeated features as if they differed,
    which is never above the true length. Kernel rows of the others are exact.
    """
    tables = _tables(landmarks)
    none = np.empty(0, np.int64), np.empty((0, len(landmarks)), np.float32)
    code, start = _encode(text)
    at = _blocks(start)
    word = np.zeros(len(code), np.int32)
    word[at[1:]] = 1
    word = np.cumsum(word, dtype=np.int32)
    wide = code.astype(np.int32)
    near, self2 = np.zeros(len(code), np.float32), np.zeros(len(code), np.float32)
    for a, b, w in PATTERNS:
        n = len(code) - b
        if n <= 0:
            continue
        x, y, z = wide[:n], wide[a:a + n], wide[b:]
        one = word[:n] == word[b:]
        near[:n] += w * tables.bound[(x * LETTERS + y) * LETTERS + z] * one
        self2[:n] += w * w * (one & (x > 0) & (y > 0) & (z > 0))
    total, low2 = np.add.reduceat(near, at), np.add.reduceat(self2, at)
    picked = np.flatnonzero((total > 0) & (total * total > 0.999 * FLOOR**2 * low2))
    if not len(picked):
        return none
    ends = np.append(at, len(code))[picked + 1]
    length = ends - at[picked]
    offset = np.cumsum(length) - length
    place = np.repeat(at[picked] - offset, length) + np.arange(length.sum())
    owner = np.repeat(np.arange(len(picked)), length)
    parts = []
    for a, b, w in PATTERNS:
        ok = place + b < len(code)
        ok[ok] = word[place[ok]] == word[place[ok] + b]
        p = place[ok]
        x, y, z = wide[p], wide[p + a], wide[p + b]
        whole = (x > 0) & (y > 0) & (z > 0)
        parts.append((owner[ok][whole], ((x * LETTERS + y) * LETTERS + z)[whole], np.full(int(whole.sum()), w, np.float32)))
    owner, feature, weight = (np.concatenate(c) for c in zip(*parts))
    norm = np.maximum(_norms(owner, feature, weight, len(picked)), 1e-6)
    # Only features of some landmark count; in word order, so many at a time.
    live = np.flatnonzero(tables.bound[feature] > 0)
    live = live[np.argsort(owner[live], kind="stable")]
    owner, feature, weight = owner[live], feature[live], weight[live]
    kernel = np.zeros((len(picked), len(landmarks)), np.float32)
    step = max(1, CELLS // max(1, len(landmarks)))
    for i in range(0, len(owner), step):
        rows = tables.values[feature[i:i + step]] * weight[i:i + step, None]
        own = owner[i:i + step]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        kernel[own[first]] += np.add.reduceat(rows, first, axis=0)
    kernel /= norm[:, None].astype(np.float32)
    kernel[kernel < FLOOR] = 0
    kept = kernel.any(axis=1)
    return at[picked][kept], kernel[kept]


def word_rows(found: list[str], landmarks: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Kernel row of each word that has one; the largest over the blocks of a long word."""
    out: dict[str, np.ndarray] = {}
    for a, b in steps(found, limit=WORD_CHARS):
        part = found[a:b]
        at, kernel = similar_words("\n".join(part), landmarks)
        start = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])  # of the white space before each word
        for i, row in zip(np.searchsorted(start, at, side="right") - 1, kernel):
            out[part[i]] = np.maximum(out[part[i]], row) if part[i] in out else row
    return out


class _Words:
    """Kernel rows of the words met so far in this worker; emptied when it holds too many."""

    def __init__(self, landmarks: tuple[str, ...]):
        self.landmarks, self.seen, self.rows, self.bytes = landmarks, set(), {}, 0

    def learn(self, found: set[str]) -> dict[str, np.ndarray]:
        if self.bytes > KEPT_BYTES:
            self.seen, self.rows, self.bytes = set(), {}, 0
        new = [w for w in found if w not in self.seen]
        extra = word_rows(new, self.landmarks)
        kept = [w for w in new if len(w) <= 64]
        self.seen.update(kept)
        self.rows.update((w, r) for w, r in extra.items() if len(w) <= 64)
        # A string's own header and place in the set, and a row with its header.
        self.bytes += sum(map(len, kept)) + 100 * len(kept) + (4 * len(self.landmarks) + 200) * len(extra)
        return self.rows | extra if len(extra) and max(map(len, extra)) > 64 else self.rows


@lru_cache(maxsize=1)
def _word_cache(landmarks: tuple[str, ...]) -> _Words:
    return _Words(landmarks)


def sentence_rows(texts: list[str | None], landmarks: tuple[str, ...]) -> list[np.ndarray]:
    """For each text the kernel rows of the sentences that have any, each the largest over its words."""
    plain = [SPACED.sub(lambda m: m[0].replace(" ", "_"), (t or "").lower()) for t in texts]
    sets = [set(t.split()) for t in plain]
    rows = _word_cache(landmarks).learn(set().union(*sets))
    out = []
    for t, own in zip(plain, sets):
        hits = own & rows.keys()
        sentences: list[np.ndarray] = []
        for line in t.split("\n") if hits else []:
            top = None
            for w in line.split():
                if w in hits:
                    top = rows[w] if top is None else np.maximum(top, rows[w])
                if top is not None and w[-1] in ".!?":
                    sentences.append(top)
                    top = None
            if top is not None:
                sentences.append(top)
        out.append(np.array(sentences) if sentences else np.empty((0, len(landmarks)), np.float32))
    return out


@dataclass(frozen=True)
class ToxicityModel:
    landmarks: tuple[str, ...]
    project: np.ndarray  # landmarks -> decision value of a sentence, Nystroem map and weights in one
    bias: float
    link: tuple[float, float, float]  # of the document: constant, largest value, log of the summed margins
    base: float  # the answer without a usable machine

    def documents(self, texts: list[str | None]) -> list[float]:
        if not self.landmarks:
            return [self.base] * len(texts)
        feats = np.array([_summary(r @ self.project + self.bias, self.bias)
                          for r in sentence_rows(texts, self.landmarks)])
        z = self.link[0] + feats @ np.array(self.link[1:])
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def _summary(values: np.ndarray, bias: float) -> tuple[float, float]:
    top = max(bias, float(values.max())) if len(values) else bias
    return top, float(np.log1p(np.maximum(values - bias, 0).sum()))


def _fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 60):
    """Squared-hinge linear machine by Newton steps on the active rows."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    theta = np.zeros(a.shape[1])
    keep = np.eye(a.shape[1]) * ridge
    keep[-1, -1] = 1e-9
    for _ in range(rounds):
        margin = 1 - y * (a @ theta)
        on = margin > 0
        part = a[on] * weight[on][:, None]
        step = np.linalg.solve(part.T @ a[on] + keep, part.T @ y[on])
        done = np.abs(step - theta).max() < 1e-6
        theta = step
        if done:
            break
    return theta[:-1], float(theta[-1])


def _fit_link(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    a = np.hstack([np.ones((len(x), 1)), x])
    theta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        g = a.T @ (weight * (p - y)) + 1e-3 * theta
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(3)
        step = np.linalg.solve(h, g)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(theta)


def _choose_landmarks(texts: list[str], y: np.ndarray, count: int) -> tuple[str, ...]:
    """Words and beginnings of words that surely speak for the toxic class, unlike one another."""
    def parts(text: str) -> set[str]:
        whole = {w.strip(".,;:!?\"'()") for w in text.lower().split()}
        return whole | {w[:k] for w in whole for k in (4, 5, 6, 7) if len(w) > k}

    toxic: Counter = Counter()
    for t, label in zip(texts, y):
        if label:
            toxic.update(parts(t))
    toxic = Counter({w: c for w, c in toxic.items() if c >= 3 and 3 <= len(w) <= BLOCK})
    clean: Counter = Counter()
    for t, label in zip(texts, y):
        if not label:
            clean.update(parts(t) & toxic.keys())
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    odds = {}
    for w, c in toxic.items():
        c0 = clean[w]
        low = np.log((c + 0.5) / n1 * n0 / (c0 + 0.5)) - np.sqrt(1 / (c + 0.5) + 1 / (c0 + 0.5))
        if low > 1:
            odds[w] = low
    picked: list[str] = []
    vectors: list[dict[int, float]] = []
    for w in sorted(odds, key=lambda w: (-odds[w], w)):
        v = _features(w)
        norm = np.sqrt(sum(x * x for x in v.values()))
        v = {k: x / norm for k, x in v.items()} if norm else {}
        if v and all(sum(x * o.get(k, 0.0) for k, x in v.items()) < 0.7 for o in vectors):
            picked.append(w)
            vectors.append(v)
            if len(picked) == count:
                break
    return tuple(picked)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label",
        per_class: int = 2000, landmarks: int = 64, ridge: float = 1.0) -> ToxicityModel:
    """Train on at most ``per_class`` documents of each class, those whose ids have the smallest hashes.

    ``labels`` has one row (key, label 0 or 1) per document. The sample is the
    documented bound of what one task learns from: ids are picked first, without
    texts, then the texts of these ids alone are read. Class shares are counted
    over all labels.
    """
    known = labels.where(F.col(label).isin(0, 1)).join(docs.select(key), key, "left_semi")
    known = known.groupBy(key).agg(F.max(label).cast("int").alias(label))
    shares = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    if len(shares) < 2:
        return ToxicityModel((), np.empty(0), 0.0, (0.0, 0.0, 0.0), float(shares.get(1, 0) > 0))
    picked = []
    for value in (0, 1):
        part = known.where(F.col(label) == value).select(key, label)
        picked += part.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(per_class).collect()
    kind = docs.schema[key].dataType.simpleString()
    chosen = small_table(docs.sparkSession, [tuple(r) for r in picked], f"{key} {kind}, {label} int")

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((int(y), t or "") for batch in batches for t, y in zip(batch["text"], batch["label"]))
        model = fit_rows([t for _, t in rows], np.array([y for y, _ in rows]), shares, landmarks, ridge)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    # One text for each id, so at most 2 * per_class rows, read by one task; the driver gets the small model alone.
    sample = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen.withColumnRenamed(label, "label")), key)
    sample = sample.groupBy(key, "label").agg(F.min("text").alias("text"))
    return pickle.loads(sample.select("text", "label").repartition(1).mapInPandas(train, "model binary").first()[0])


def fit_rows(texts: list[str], y: np.ndarray, shares: dict[int, int], landmarks: int = 64,
             ridge: float = 1.0) -> ToxicityModel:
    """Train on sentences of the given labelled texts; ``shares`` counts the labels of all rows."""
    total = sum(shares.values())
    marks = _choose_landmarks(texts, y, landmarks)
    if not marks:
        return ToxicityModel((), np.empty(0), 0.0, (0.0, 0.0, 0.0), shares[1] / total)
    gram = np.vstack([similar_words(m, marks)[1][:1] for m in marks]).astype(float)
    size, axes = np.linalg.eigh(gram)
    nystroem = axes / np.sqrt(np.maximum(size, 0.05))
    per_doc = [r for a, b in steps(texts, limit=STEP_CHARS) for r in sentence_rows(texts[a:b], marks)]
    class_weight = {v: 1000.0 / max(1, int((y == v).sum())) for v in (0, 1)}
    found = np.vstack(per_doc)
    target = np.repeat(np.where(y == 1, 1.0, -1.0), [len(p) for p in per_doc])
    weight = np.repeat([class_weight[v] for v in y], [len(p) for p in per_doc])
    # Sentences without any match are alike: one row for each class stands for them.
    blank = np.zeros((2, len(marks)))
    x = np.vstack([found, blank]) @ nystroem
    target = np.append(target, [1.0, -1.0])
    weight = np.append(weight, [200.0, 1000.0])
    theta, bias = _fit_machine(x, target, weight, ridge)
    project = nystroem @ theta
    feats = np.array([_summary(p @ project + bias, bias) for p in per_doc])
    prior = np.array([shares[v] / total / max(1, (y == v).sum()) for v in y]) * len(y)
    link = _fit_link(feats, y, prior)
    _word_cache.cache_clear()
    return ToxicityModel(marks, project, bias, link, shares[1] / total)


def score(text: Column, model: ToxicityModel) -> Column:
    """Score from 0 to 1 of each whole text."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        values = texts.tolist()
        for a, b in steps(values, limit=STEP_CHARS):
            out += model.documents(values[a:b])
        return pd.Series(out, dtype=float)

    return run(text)
