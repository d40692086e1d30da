"""Supervised subword embeddings for document quality.

A document is the mean of the learned vectors of its words, neighbouring word
pairs and character n-grams (all hashed into one table), followed by a softmax.
Numpy stochastic gradient descent trains it on a bounded sample of labelled
rows.  A linear softmax over a mean of vectors is the mean of one number per
feature, so the trained table that scoring ships to the tasks is one float per
bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import batch_words, char_grams, distinct_words, mix64, slices, small_batches, word_hashes


@dataclass(frozen=True)
class QualitySettings:
    buckets: int = 1 << 18
    dim: int = 8
    grams: tuple[int, ...] = (2, 3)
    most_per_class: int = 3000      # labelled rows of each class that training looks at
    epochs: int = 6
    least_steps: int = 20_000       # a small sample is passed over more often
    rate: float = 0.5
    threshold: float = 0.3
    seed: int = 11
    batch_chars: int = 500_000


@dataclass(frozen=True)
class QualityModel:
    table: np.ndarray               # logit of label 1 that a feature in this bucket adds, before averaging
    bias: float
    settings: QualitySettings


class Features:
    """Hashed features of a batch of texts, kept per distinct word so that repeated words cost one lookup."""

    def __init__(self, texts: list[str | None], s: QualitySettings):
        words, self.counts = batch_words(texts)
        self.codes, distinct = distinct_words(words)
        mask = np.uint64(s.buckets - 1)
        hashes = word_hashes(distinct)
        self.word = (mix64(hashes, 1) & mask).astype(np.int64)
        grams, self.gram_word = char_grams(distinct, s.grams)
        self.gram = (grams & mask).astype(np.int64)
        self.gram_count = np.bincount(self.gram_word, minlength=len(distinct))
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.pair = np.zeros(0, np.int64)
        self.pair_owner = np.zeros(0, np.int64)
        if len(self.codes) > 1:
            h = hashes[self.codes]
            inside = self.owner[1:] == self.owner[:-1]
            pair = mix64(h[:-1] * np.uint64(3) + h[1:], 2)
            pair[h[:-1] == h[1:]] = mix64(np.ones(1, np.uint64), 3)[0]  # any word said twice is one and the same pair
            self.pair = (pair[inside] & mask).astype(np.int64)
            self.pair_owner = self.owner[1:][inside]

    def totals(self) -> np.ndarray:
        """Features of each text."""
        each = 1 + self.gram_count[self.codes] if len(self.codes) else np.zeros(0)
        n = len(self.counts)
        return np.bincount(self.owner, weights=each, minlength=n) + np.bincount(self.pair_owner, minlength=n)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's values over the features of each text."""
        n = len(self.counts)
        per_word = table[self.word] + np.bincount(self.gram_word, weights=table[self.gram], minlength=len(self.word))
        return (np.bincount(self.owner, weights=per_word[self.codes], minlength=n)
                + np.bincount(self.pair_owner, weights=table[self.pair], minlength=n))

    def sparse(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of one text and how often each occurs."""
        used, times = np.unique(self.codes[self.owner == i], return_counts=True)
        per_word = np.zeros(len(self.word), np.int64)
        per_word[used] = times
        mine = per_word[self.gram_word] > 0
        buckets = np.concatenate([self.word[used], self.gram[mine], self.pair[self.pair_owner == i]])
        weights = np.concatenate([times, per_word[self.gram_word[mine]], np.ones((self.pair_owner == i).sum(), np.int64)])
        found, at = np.unique(buckets, return_inverse=True)
        return found.astype(np.int32), np.bincount(at, weights=weights, minlength=len(found)).astype(np.float32)


def held_out(column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _usable(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id", 5, 0))


def training_rows(docs: DataFrame, labels: DataFrame, s: QualitySettings) -> DataFrame:
    """Text and label of at most ``most_per_class`` labelled documents a class, none of them held out."""
    known = _usable(labels).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("y"))
    order = F.xxhash64("doc_id", F.lit(s.seed))
    picked = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(s.most_per_class) for y in (0, 1)]
    sample = picked[0].union(picked[1])   # bounded by the setting, so it may be broadcast
    return (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")))


def train(docs: DataFrame, labels: DataFrame, s: QualitySettings = QualitySettings()) -> QualityModel:
    """Fit on the bounded sample; class frequencies of all usable labels set the prior."""

    def sparse_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in slices(batch["text"].str.len().fillna(0).to_numpy(np.int64), s.batch_chars):
                part = batch.iloc[a:b]
                made = Features(list(part["text"]), s)
                rows = [made.sparse(i) for i in range(len(part))]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "y": part["y"].to_numpy(),
                                    "at": [r[0] for r in rows], "n": [r[1] for r in rows]})

    small_batches(docs)
    share = _usable(labels).agg(F.avg("quality").alias("p")).first()["p"]
    rows = training_rows(docs, labels, s).repartition(8, "doc_id").mapInPandas(
        sparse_rows, "doc_id long, y int, at array<int>, n array<float>")
    sample = rows.toArrow().to_pandas().sort_values("doc_id") if share is not None else pd.DataFrame()
    return fit(sample, s, share)


def fit(sample: pd.DataFrame, s: QualitySettings, share: float | None) -> QualityModel:
    """Stochastic gradient descent over sparse bags of buckets; one class alone gives a constant score."""
    prior = min(max(0.5 if share is None else share, 0.001), 0.999)
    usual = float(np.log(prior / (1 - prior)))
    if not len(sample) or sample["y"].nunique() < 2:
        return QualityModel(np.zeros(s.buckets, np.float32), usual, s)
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (s.dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    y = sample["y"].to_numpy()
    bags = [(at, n / max(n.sum(), 1)) for at, n in zip(sample["at"], sample["n"], strict=True)]
    balance = len(y) / (2 * np.bincount(y, minlength=2))
    epochs = max(s.epochs, -(-s.least_steps // len(y)))
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, share_of = bags[i]
            rate = np.float32(s.rate * (1 - done / steps) * balance[y[i]])
            done += 1
            mean = share_of @ vectors[at]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * 0.1 * np.outer(mean, p)
            bias -= rate * 0.02 * p
            vectors[at] -= rate * share_of[:, None] * back * np.float32(10)
    table = vectors @ (out[:, 1] - out[:, 0])
    return QualityModel(table.astype(np.float32), float(bias[1] - bias[0]) + usual, s)


def quality_score(model: QualityModel, text: str = "text") -> Column:
    """Probability of label 1 from the text alone; a text without words gets the score of the prior."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        s, parts = model.settings, []
        for a, b in slices(texts.str.len().fillna(0).to_numpy(np.int64), s.batch_chars):
            made = Features(list(texts.iloc[a:b]), s)
            logit = made.sums(model.table) / np.maximum(made.totals(), 1) + model.bias
            parts.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame, s: QualitySettings = QualitySettings()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Rows that repeat an id are scored one by one; null labels, labels of
    unknown documents and null ids take no part in training.
    """
    model = train(docs, labels, s)
    scored = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), quality_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, s: QualitySettings = QualitySettings()) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    return docs.where(quality_score(train(docs, labels, s)) >= s.threshold)
