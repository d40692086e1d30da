"""Language of words and documents by a linear-chain conditional random field.

Every word gets emission scores from hashed affixes and character n-grams, the
word itself, and membership in per-language lexicons; learned transitions join
neighbours, and forward-backward gives each word's posterior, so code-switched
text is labelled word by word.  Training joins stretches of documents of
different languages, drawn from a bounded sample, and follows the exact
gradient.  Forward-backward over a batch works on pieces of equal length side
by side and passes messages between the pieces of one text, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import batch_words, char_grams, distinct_words, mix64, slices, small_batches, word_hashes
from attesta.llm.quality import held_out


@dataclass(frozen=True)
class LanguageSettings:
    buckets: int = 1 << 16
    grams: tuple[int, ...] = (2, 3, 4)  # of the word with its ends marked, so prefixes and suffixes are among them
    per_language: int = 400             # training documents of each language, about
    words_each: int = 200               # consecutive words that training takes from each
    sequences: int = 1500
    epochs: int = 3
    rate: float = 0.5
    lexicon_times: int = 3              # a lexicon word occurs so often, and
    lexicon_share: float = 0.8          # so often in its language
    piece: int = 64
    batch_chars: int = 500_000
    seed: int = 5


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray                 # (buckets, languages)
    lexicon: dict[str, int]             # word -> language it is typical of
    lexicon_weights: np.ndarray         # (languages, languages)
    transitions: np.ndarray             # (languages, languages), log scale
    settings: LanguageSettings

    def emissions(self, words: np.ndarray) -> np.ndarray:
        """Log scores of each distinct word; a word without letters says nothing."""
        k, s = len(self.languages), self.settings
        mask = np.uint64(s.buckets - 1)
        grams, owner = char_grams(words, s.grams)
        at = (grams & mask).astype(np.int64)
        count = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        whole = (mix64(word_hashes(words), 4) & mask).astype(np.int64)
        out = np.empty((len(words), k))
        for j in range(k):
            column = self.weights[:, j]
            out[:, j] = np.bincount(owner, weights=column[at], minlength=len(words)) / count + column[whole]
        known = np.fromiter((self.lexicon.get(w.strip(EDGE), -1) for w in words), np.int64, len(words))
        out[known >= 0] += self.lexicon_weights[known[known >= 0]]
        out[~lettered(words)] = 0.0
        return out


EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»…–—¿¡"


def lettered(words: np.ndarray) -> np.ndarray:
    return np.fromiter((any(c.isalpha() for c in w) for w in words), bool, len(words))


def forward_backward(emissions: np.ndarray, counts: np.ndarray, transitions: np.ndarray, piece: int) -> np.ndarray:
    """Posterior of every word of several texts that lie end to end.

    Texts are cut into pieces; each piece's transfer matrix gives the messages
    that reach its ends, then one pass each way inside the pieces gives the
    posteriors.
    """
    n, k = emissions.shape
    step = np.exp(transitions - transitions.max())
    score = np.exp(emissions - emissions.max(axis=1, keepdims=True)) if n else emissions
    per = -(-counts // piece)
    pieces = int(per.sum())
    if not pieces:
        return np.zeros((0, k))
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(pieces) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(counts) - counts)[text] + nth * piece
    length = np.minimum(piece, (np.cumsum(counts))[text] - begin)
    order = np.argsort(-length, kind="stable")                       # pieces still running stay in front
    begin, length, text, nth = begin[order], length[order], text[order], nth[order]
    running = [int((length > i).sum()) for i in range(piece)]
    transfer = np.broadcast_to(np.eye(k), (pieces, k, k)).copy()
    for i in range(piece):
        m = running[i]
        if not m:
            break
        t = (transfer[:m] @ step) * score[begin[:m] + i][:, None, :]
        transfer[:m] = t / t.max(axis=(1, 2), keepdims=True)
    into, after = np.full((pieces, k), 1.0 / k), np.ones((pieces, k))
    place = np.empty(pieces, np.int64)
    place[order] = np.arange(pieces)                                 # of a piece in text order
    starts = np.cumsum(per) - per
    for j in range(1, int(per.max())):
        live = np.flatnonzero(per > j)
        here, before = place[starts[live] + j], place[starts[live] + j - 1]
        a = np.einsum("ij,ijk->ik", into[before], transfer[before])
        into[here] = a / a.sum(axis=1, keepdims=True)
    for j in range(int(per.max()) - 2, -1, -1):
        live = np.flatnonzero(per > j + 1)
        here, nxt = place[starts[live] + j], place[starts[live] + j + 1]
        b = np.einsum("ijk,ik->ij", transfer[nxt], after[nxt])
        after[here] = b / b.max(axis=1, keepdims=True)
    forward = np.empty((n, k))
    for i in range(piece):
        m = running[i]
        if not m:
            break
        a = (into[:m] @ step) * score[begin[:m] + i]
        into[:m] = a / a.sum(axis=1, keepdims=True)
        forward[begin[:m] + i] = into[:m]
    for i in range(piece - 1, -1, -1):
        m = running[i]
        if not m:
            continue
        at = begin[:m] + i
        both = forward[at] * after[:m]
        b = (score[at] * after[:m]) @ step.T
        after[:m] = b / b.max(axis=1, keepdims=True)
        forward[at] = both / both.sum(axis=1, keepdims=True)
    return forward


def _gradient(emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors and expected transition counts of one sequence."""
    n, k = emissions.shape
    step, score = np.exp(transitions), np.exp(emissions - emissions.max(axis=1, keepdims=True))
    alpha, beta = np.empty((n, k)), np.ones((n, k))
    a = np.full(k, 1.0 / k)
    for i in range(n):
        a = (a @ step) * score[i]
        a /= a.sum()
        alpha[i] = a
    for i in range(n - 2, -1, -1):
        b = step @ (score[i + 1] * beta[i + 1])
        beta[i] = b / b.sum()
    posterior = alpha * beta
    posterior /= posterior.sum(axis=1, keepdims=True)
    pairs = alpha[:-1, :, None] * step[None] * (score[1:] * beta[1:])[:, None, :]
    return posterior, (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit(samples: list[tuple[int, list[str]]], languages: tuple[str, ...], s: LanguageSettings) -> LanguageModel:
    """Gradient ascent on the likelihood of code-switched sequences made of stretches of the samples."""
    k = len(languages)
    counts: dict[str, np.ndarray] = {}
    for lang, words in samples:
        for w in words:
            counts.setdefault(w.strip(EDGE), np.zeros(k, np.int64))[lang] += 1
    lexicon = {w: int(c.argmax()) for w, c in counts.items()
               if w and c.sum() >= s.lexicon_times and c.max() >= s.lexicon_share * c.sum()}
    model = LanguageModel(languages, np.zeros((s.buckets, k)), lexicon, np.zeros((k, k)), np.zeros((k, k)), s)
    if k < 2 or not samples:
        return model
    rng, mask = np.random.default_rng(s.seed), np.uint64(s.buckets - 1)
    by_language = [[words for lang, words in samples if lang == j and words] for j in range(k)]
    usable = [j for j in range(k) if by_language[j]]
    for epoch in range(s.epochs):
        rate = s.rate / (1 + epoch)
        for _ in range(s.sequences):
            words, truth = [], []
            for _ in range(rng.integers(2, 5)):
                lang = usable[rng.integers(len(usable))]
                source = by_language[lang][rng.integers(len(by_language[lang]))]
                size, at = int(rng.integers(4, 16)), int(rng.integers(max(1, len(source) - 3)))
                words += source[at:at + size]
                truth += [lang] * len(source[at:at + size])
            array, y = np.array(words, object), np.array(truth)
            posterior, expected = _gradient(model.emissions(array), model.transitions)
            error = np.eye(k)[y] - posterior
            error[~lettered(array)] = 0
            grams, owner = char_grams(array, s.grams)
            share = 1 / np.maximum(np.bincount(owner, minlength=len(array)), 1)
            np.add.at(model.weights, (grams & mask).astype(np.int64), rate * 4 * error[owner] * share[owner][:, None])
            np.add.at(model.weights, (mix64(word_hashes(array), 4) & mask).astype(np.int64), rate * error)
            known = np.array([lexicon.get(w.strip(EDGE), -1) for w in words])
            np.add.at(model.lexicon_weights, known[known >= 0], rate * 0.1 * error[known >= 0])
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:-1], y[1:]), 1)
            model.transitions[:] += rate * 0.02 * (seen - expected)
    return model


def train(docs: DataFrame, s: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Fit on about ``per_language`` documents of each language that are not held out."""
    small_batches(docs)
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 3, 1))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return fit([], languages, s)
    rate = F.create_map(*[F.lit(v) for name in languages for v in (name, min(1.0, s.per_language / sizes[name]))])
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30))

    def stretch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = text.lower().split()
                at = int(doc) * 7919 % max(1, len(words) - s.words_each + 1)
                made.append(words[at:at + s.words_each])
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "lang": batch["lang"].to_numpy(), "words": pd.Series(made, dtype=object)})

    rows = drawn.mapInPandas(stretch, "doc_id long, lang string, words array<string>").groupBy("doc_id").agg(
        F.min(F.struct("lang", "words")).alias("_one")).select("doc_id", "_one.*")
    sample = rows.toArrow().to_pandas().sort_values("doc_id")
    return fit([(languages.index(name), list(words)) for name, words in zip(sample["lang"], sample["words"], strict=True)], languages, s)


def _labelled(model: LanguageModel, texts: list[str | None]):
    """Words of a batch, their counts per text, posteriors, and which have letters."""
    words, counts = batch_words(texts, lower=True)
    codes, distinct = distinct_words(words)
    emissions = model.emissions(distinct)[codes] if len(codes) else np.zeros((0, max(len(model.languages), 1)))
    letters = lettered(distinct)[codes] if len(codes) else np.zeros(0, bool)
    return words, counts, forward_backward(emissions, counts, model.transitions, model.settings.piece), letters


def identify_languages(docs: DataFrame, s: LanguageSettings = LanguageSettings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score (share of the text's posterior) for every row.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text when nothing is labelled.  Rows that repeat an id are judged one by one.
    """
    model = train(docs, s)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for a, b in slices(texts.str.len().fillna(0).to_numpy(np.int64), s.batch_chars):
            _, counts, posterior, letters = _labelled(model, list(texts.iloc[a:b]))
            owner = np.repeat(np.arange(len(counts)), counts)
            mass = np.stack([np.bincount(owner[letters], weights=posterior[letters, j], minlength=len(counts))
                             for j in range(posterior.shape[1])], axis=1)
            total = mass.sum(axis=1)
            for row, all_of_it in zip(mass, total, strict=True):
                best = int(row.argmax())
                told = all_of_it > 0 and model.languages
                names.append(model.languages[best] if told else "und")
                scores.append(float(row[best] / all_of_it) if told else 0.0)
        return pd.DataFrame({"lang": names, "score": scores})

    rows = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), predict("text").alias("_p"))
    return rows.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def label_words(docs: DataFrame, s: LanguageSettings = LanguageSettings()) -> DataFrame:
    """doc_id and its stretches of one language: (lang, words), ``und`` for words without a letter before any other."""
    model = train(docs, s)

    @F.pandas_udf("array<struct<lang:string,words:string>>")
    def stretches(texts: pd.Series) -> pd.Series:
        out = []
        for a, b in slices(texts.str.len().fillna(0).to_numpy(np.int64), s.batch_chars):
            words, counts, posterior, letters = _labelled(model, list(texts.iloc[a:b]))
            best, at = posterior.argmax(axis=1), 0
            for n in counts:
                runs: list[dict] = []
                for i in range(at, at + n):
                    name = model.languages[best[i]] if letters[i] and model.languages else (runs[-1]["lang"] if runs else "und")
                    if runs and runs[-1]["lang"] == name:
                        runs[-1]["words"] += " " + words[i]
                    else:
                        runs.append({"lang": name, "words": words[i]})
                at += n
                out.append(runs)
        return pd.Series(out, dtype=object)

    return docs.select("doc_id", stretches("text").alias("stretches"))
