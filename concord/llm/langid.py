"""Language of a text by bit-sliced Bloom filters over letter trigrams.

All languages' Bloom filters lie side by side: a row of the table holds one bit
for each language, and a trigram's rows ANDed give the languages that contain
it. A language contains a trigram that is common enough in it and not far more
common in another. A text goes to the language with the most trigrams, each
count corrected for the share of false positives of that language's filter.

Counts are taken over all learning texts. A language has at most 1 / ``SHARE``
trigrams by construction, which bounds the model.

Defined results: a text that is null, empty or without letters is ``und`` with
score 0; so is every text if nothing was learned; a text without any known
trigram goes to the most frequent language with score 0; ties go to the smaller
name; rows without a language teach nothing; every row yields one row and its
other columns are left alone. Whole texts of any length are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.llm.text import mix, steps

#: Least share of a language's trigrams that one must have.
SHARE = 2e-5
#: A trigram belongs to a language where its share is at least this part of its largest share.
RATIO = 0.25
HASHES = 3
UNKNOWN = "und"
STEP_CHARS = 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x3000)])


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram, number of its text) of several texts, and which texts have letters.

    Whatever is no letter is one blank; a trigram has a letter in its middle.
    """
    whole = "\n".join((t or "").lower() for t in texts)
    points = np.frombuffer(f"\n{whole}\n".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _letters()
    letter = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], True)
    c = np.where(letter, points, 0).astype(np.uint64)
    size = np.array([len((t or "").lower()) + 1 for t in texts])
    at = np.flatnonzero(letter)
    gram = (c[at - 1] << np.uint64(42)) | (c[at] << np.uint64(21)) | c[at + 1]
    doc = np.searchsorted(np.cumsum(size), at - 1, side="right")
    return gram, doc, np.bincount(doc, minlength=len(texts)) > 0


def _counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): the trigrams of all texts, added up within each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.Series] = {}
        for batch in batches:
            for name, group in batch.groupby("lang"):
                texts = group["text"].tolist()
                for a, b in steps(texts, limit=STEP_CHARS):
                    n = pd.Series(trigrams(texts[a:b])[0].astype(np.int64)).value_counts(sort=False)
                    held[name] = held[name].add(n, fill_value=0) if name in held else n
                if len(held[name]) > 1_000_000:
                    yield _rows(name, held.pop(name))
        for name, n in held.items():
            yield _rows(name, n)

    return docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInPandas(
        run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _rows(name: str, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"lang": name, "gram": n.index.to_numpy(np.int64), "n": n.to_numpy(np.int64)})


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # (rows, words of 64 languages)
    false_share: np.ndarray  # for each language
    usual: int  # the most frequent language

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """Bits of all languages that contain each trigram."""
        out = None
        for row in _places(gram, len(self.table)):
            out = self.table[row] if out is None else out & self.table[row]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        gram, doc, lettered = trigrams(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = np.bincount(doc, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        mask = self.masks(gram.astype(np.uint64))
        for i in range(len(self.languages)):
            bit = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits[:, i] = np.bincount(doc, weights=bit.astype(float), minlength=len(texts))
        true = np.maximum(0, (hits - total[:, None] * self.false_share) / (1 - self.false_share))
        best, whole = true.argmax(axis=1), true.sum(axis=1)
        best[whole == 0] = self.usual
        share = np.where(whole > 0, true.max(axis=1) / np.maximum(whole, 1e-300), 0.0)
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered)]
        return names, np.where(lettered, share, 0.0).tolist()


def _places(gram: np.ndarray, rows: int) -> list[np.ndarray]:
    h = mix(gram)
    step = mix(h) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(rows - 1)).astype(np.int64) for k in range(HASHES)]


def build(found: pd.DataFrame, totals: dict[str, int]) -> LanguageModel:
    """Filters from the kept (lang, gram) rows."""
    languages = tuple(sorted(totals))
    most = int(found.groupby("lang").size().max()) if len(found) else 1
    rows = 1 << max(10, (8 * most - 1).bit_length())
    table = np.zeros((rows, -(-len(languages) // 64) or 1), np.uint64)
    for name, group in found.groupby("lang"):
        i = languages.index(name)
        for row in _places(group["gram"].to_numpy(np.int64).astype(np.uint64), rows):
            table[row, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    usual = max(range(len(languages)), key=lambda i: totals[languages[i]]) if languages else 0
    return LanguageModel(languages, table, fill ** HASHES, usual)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE, ratio: float = RATIO) -> LanguageModel:
    """Learn from all rows with a language; at most 1 / ``share`` trigrams of each language reach the driver."""
    counts = _counts(docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang)
    part = counts.withColumn("all", F.sum("n").over(W.partitionBy("lang")))
    part = part.withColumn("p", F.col("n") / F.col("all")).where(F.col("p") >= share)
    kept = part.withColumn("top", F.max("p").over(W.partitionBy("gram"))).where(F.col("p") >= ratio * F.col("top"))
    found = kept.select("lang", "gram", "all").toPandas()
    totals = {r.lang: int(r.all) for r in found.drop_duplicates("lang").itertuples()}
    return build(found[["lang", "gram"]], totals)


def predict(text: Column, model: LanguageModel) -> Column:
    """Struct (lang_pred, score) of each whole text."""

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        values = texts.tolist()
        for a, b in steps(values, limit=STEP_CHARS):
            n, s = model.predict(values[a:b])
            names += n
            scores += s
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return run(text)
