"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Windows of eight template tokens of the benchmark are joined by hash with those
of the documents, so a question that comes back with other numbers or names is
still found.  Placeholder values are compared along each alignment: an item's
value must always turn into the same value of the document, or the match is a
chance one.  A capital that opens a sentence is read both as a plain word and as
a name.  Windows are looked for literally as well: by their words whatever case
and place they have, and, where a template would say too little (mostly
placeholders, or too few tokens), by their words with the signs between them.  A bitmap of fixed size built from the benchmark's windows spares
the join the document windows that cannot match; the join itself is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import distinct_words, free_name, key_filter, mix64, passes, slices, small_batches, text_hash, word_hashes
from attesta.session import cut_lineage

# Unit words that may follow a number.
UNITS = frozenset("""
km m cm mm mi miles mile feet foot ft inches inch yards yard kg g mg lb lbs pounds pound oz ounces tons ton
l ml liters litres liter litre gallons gallon s sec seconds second min minutes minute h hr hours hour days day
weeks week months month years year mph kmh kph degrees degree percent dollars dollar cents cent euros euro usd eur
""".split())
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»…–—¿¡"
NUMBER = re.compile(r"\d[\d.,]*$")
GLUED = re.compile(r"(\d[\d.,]*)([A-Za-z]+)$")
PLAIN, NUM, UNIT, CAPITAL, LINE, NOTHING, BOTH = range(7)
LINE_MARK = "\x1e"


@dataclass(frozen=True)
class TemplateSettings:
    window: int = 8
    shortest: int = 4           # items of fewer template tokens are searched literally only
    least_plain: float = 0.5    # share of a window that must not be placeholders, or it is searched literally only
    coverage: float = 0.5       # share of an item's windows that a leak shows
    consistent: float = 0.8     # share of an item's values that turn into one value each
    filter_bits: int = 24       # 2 MB
    batch_chars: int = 500_000


def _kind(word: str) -> tuple[int, str]:
    """Kind of a raw word and its core, lower-cased; a word without a core is its own."""
    if word == LINE_MARK:
        return LINE, ""
    core = word.strip(EDGE)
    if not core:
        return NOTHING, word
    low = core.lower()
    if core[0].isdigit():
        if NUMBER.match(core):
            return NUM, low
        glued = GLUED.match(core)
        if glued and glued[2].lower() in UNITS:
            return BOTH, low
    if low in UNITS:
        return UNIT, low
    return (CAPITAL if core[0].isupper() else PLAIN), low


@dataclass
class Reading:
    """One way to read the words of a batch as tokens: the word each starts with, its text, kind and id."""

    family: int                 # only keys of one family are compared
    at: np.ndarray
    owner: np.ndarray
    kinds: np.ndarray
    ids: np.ndarray
    opening: np.ndarray         # capitals that open a sentence
    lead: np.ndarray | None = None   # share of the id that comes from before the token, which a window does not begin with

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and keys of the windows that lie in one text, how many plain words each holds, and how many openings."""
        n = len(self.ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.full(n, width, np.uint64)
        for i in range(width):
            key = key * np.uint64(PRIME) + self.ids[i:n + i]
        if self.lead is not None:
            key -= self.lead[:n] * np.uint64(pow(PRIME, width - 1, 1 << 64))
        start = np.flatnonzero(self.owner[:n] == self.owner[width - 1:])
        plain, opening = (np.concatenate([[0], np.cumsum(x)]) for x in (self.kinds == PLAIN, self.opening))
        return start, mix64(key[start], self.family).view(np.int64), plain[start + width] - plain[start], opening[start + width] - opening[start]


class Templates:
    """Readings of a batch of texts, and the values that placeholders stand for.

    ``plain`` and ``named`` are templates with the capitals that open a sentence
    as plain words and as names; ``folded`` and ``exact`` are literal.
    ``place`` numbers the tokens of ``named`` within their text, by word.
    """

    def __init__(self, texts: list[str | None]):
        words: list[str] = []
        counts = []
        for text in texts:
            mine = text.replace("\n", f" {LINE_MARK} ").split() if text else []
            counts.append(len(mine))
            words += mine
        codes, distinct = distinct_words(words)
        pairs = [_kind(w) for w in distinct]
        kind = np.array([k for k, _ in pairs], np.int8)
        self.cores = np.array([c for _, c in pairs], object)
        hashes = mix64(word_hashes(self.cores)) if len(pairs) else np.zeros(1, np.uint64)
        stops = np.array([w.rstrip("\"')”’»")[-1:] in (".", "!", "?", ":") for w in distinct], bool)
        owner = np.repeat(np.arange(len(counts)), counts)
        kinds = kind[codes] if len(codes) else np.zeros(0, np.int8)
        ends = (kinds == LINE) | (stops[codes] if len(codes) else False)
        fresh = np.ones(len(codes), bool)                  # first word of a sentence, line or text
        fresh[1:] = (owner[1:] != owner[:-1]) | ends[:-1]
        signs = np.cumsum(np.where(kinds == NOTHING, hashes[codes], 0).astype(np.uint64))
        kept = (kinds != LINE) & (kinds != NOTHING)
        times = np.where(kinds == BOTH, 2, 1)[kept]
        codes, owner, fresh, signs = (np.repeat(x[kept], times) for x in (codes, owner, fresh, signs))
        kinds = np.repeat(kinds[kept], times)
        second = np.zeros(len(kinds), bool)
        second[1:] = (kinds[1:] == BOTH) & (kinds[:-1] == BOTH) & (np.arange(len(kinds)) == np.repeat(
            np.cumsum(times) - 1, times))[1:]
        kinds = np.where(kinds == BOTH, np.where(second, UNIT, NUM), kinds)
        number_before = np.zeros(len(kinds), bool)
        number_before[1:] = (kinds[:-1] == NUM) & (owner[1:] == owner[:-1])
        kinds = np.where((kinds == UNIT) & ~number_before, PLAIN, kinds)
        self.codes, self.owner = codes, owner
        marks, said, opening = mix64(np.arange(NOTHING + 1), 9), hashes[codes], (kinds == CAPITAL) & fresh

        def template(name: np.ndarray, begins: np.ndarray) -> Reading:
            again = np.zeros(len(kinds), bool)             # a name of several words is one placeholder
            again[1:] = name[1:] & name[:-1] & (owner[1:] == owner[:-1]) & ~begins[1:]
            at = np.flatnonzero(~again)
            mine = np.where(name, CAPITAL, np.where(kinds == CAPITAL, PLAIN, kinds))[at]
            ids = np.where(mine == PLAIN, said[at], marks[mine]).astype(np.uint64)
            return Reading(0, at, owner[at], mine, ids, opening[at])

        none = np.zeros(len(kinds), bool)
        self.plain, self.named = template((kinds == CAPITAL) & ~fresh, none), template(kinds == CAPITAL, opening)
        one = np.zeros(len(kinds), np.int64)
        one[self.named.at] = 1
        number = np.cumsum(one) - 1
        self.place = number - number[np.searchsorted(owner, owner)] if len(owner) else number
        every, kinds = np.arange(len(kinds)), np.where(opening, PLAIN, kinds)
        self.folded = Reading(1, every, owner, kinds, said, none)
        before = mix64(np.diff(signs, prepend=signs[:1]), 8)
        self.exact = Reading(2, every, owner, kinds, said + before, none, before)

    def slots(self, r: Reading, start: int, width: int) -> list[str]:
        return [self.cores[self.codes[r.at[i]]] for i in range(start, start + width) if r.kinds[i] != PLAIN] if not r.family else []

    def openings(self, r: Reading, start: int, width: int) -> list[bool]:
        return [bool(r.opening[i]) for i in range(start, start + width) if r.kinds[i] != PLAIN] if not r.family else []


def _parts(s: TemplateSettings, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Templates]]:
    for batch in batches:
        for a, b in slices(batch["text"].str.len().fillna(0).to_numpy(np.int64), s.batch_chars):
            part = batch.iloc[a:b]
            yield part, Templates(list(part["text"]))


def _item_rows(s: TemplateSettings):
    """Windows of the items, each text cut at its own width; sets of windows that coverage is counted in."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, made in _parts(s, batches):
            length = {r: np.bincount(getattr(made, r).owner, minlength=len(part)) for r in ("plain", "named", "folded")}
            own = {r: np.minimum(n, s.window) for r, n in length.items()} | {"exact": np.minimum(length["folded"], s.window)}
            rows = []
            for name in own:
                r = getattr(made, name)
                for width in sorted({int(w) for w in own[name] if w}):
                    start, key, plain, opening = r.windows(width)
                    who = r.owner[start]
                    speaks = (plain >= s.least_plain * width) & (length["plain" if r.family else name][who] >= s.shortest)
                    mine = (own[name][who] == width) & (~speaks if name == "exact" else speaks)
                    if name == "named":
                        mine &= opening > 0
                    start, key, who, opening = start[mine], key[mine], who[mine], opening[mine]
                    rows.append(pd.DataFrame({
                        "_row": who, "pos": made.place[r.at[start]].astype(np.int32), "key": key,
                        "family": np.int32(r.family), "width": np.int32(width),
                        "slots": [made.slots(r, i, width) for i in start], "opens": [made.openings(r, i, width) for i in start],
                        "in_plain": name == "plain",
                        "in_named": (name == "named") | ((name == "plain") & (opening == 0) & (own["named"][who] == width))}))
            out = pd.concat(rows) if rows else pd.DataFrame()
            if not len(out):
                continue
            where = ["_row", "pos"]
            sets = out.groupby(where)[["in_plain", "in_named"]].max().astype(int).assign(n_all=1)
            totals = sets.groupby("_row").sum().rename(columns={"in_plain": "n_plain", "in_named": "n_named"}).astype(np.int32)
            out = out.drop(columns=["in_plain", "in_named"]).join(sets[["in_plain", "in_named"]].astype(bool), on=where).join(totals, on="_row")
            for c in ("item_id", "_t"):
                out[c] = part[c].to_numpy()[out["_row"]]
            yield out[ITEM_ROW]

    return work


def _text_rows(s: TemplateSettings, widths: dict[int, list[int]], bitmap: np.ndarray):
    """Windows of the documents that the bitmap lets pass, at every width that the items have."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, made in _parts(s, batches):
            for r in (made.plain, made.named, made.folded, made.exact):
                for width in widths.get(r.family, []):
                    start, key, plain, opening = r.windows(width)
                    hit = passes(bitmap, key)
                    if not r.family:
                        hit &= plain >= s.least_plain * width
                    if r is made.named:
                        hit &= opening > 0                 # the others are windows of the plain reading
                    start, key = start[hit], key[hit]
                    if len(start):
                        who = r.owner[start]
                        yield pd.DataFrame({c: part[c].to_numpy()[who] for c in ("doc_id", "_h")} | {
                            "key": key, "_at": np.int32(-1) if r.family else made.place[r.at[start]].astype(np.int32),
                            "_said": [made.slots(r, i, width) for i in start]})

    return work


PRIME = 0x100000001B3
ITEM_ROW = ["item_id", "_t", "pos", "key", "family", "width", "slots", "opens", "in_plain", "in_named", "n_plain", "n_named", "n_all"]
ITEM_SHAPE = ("item_id long, _t long, pos int, key long, family int, width int, slots array<string>, opens array<boolean>, "
              "in_plain boolean, in_named boolean, n_plain int, n_named int, n_all int")


def find_leaks(docs: DataFrame, benchmark: DataFrame, s: TemplateSettings = TemplateSettings()) -> DataFrame:
    """One row per document and benchmark item that it leaks: (doc_id, _h, item_id, matched, windows, coverage, verbatim).

    ``coverage`` is the share of the item's windows found, literally or along
    alignments with consistent values.  It is the largest of three: among the
    windows with enough plain words when openings are read as words, when they
    are read as names, and among all windows.  ``verbatim`` says that each
    window found is also found with the item's own values.
    Null texts and texts without words match nothing; null document ids are carried
    along; repeated documents and repeated items give their pair once.  An item
    without id is searched like others, one pair a text, unless its text also has an id.
    """
    small_batches(docs)
    same_text = benchmark.select("item_id", "text", text_hash().alias("_t")).distinct()
    has_id = same_text.where("item_id is not null").select("_t").distinct()
    items = same_text.where("item_id is not null").withColumn("_t", F.lit(0).cast("long")).union(
        same_text.where("item_id is null").join(has_id, "_t", "left_anti").select("item_id", "text", "_t"))
    searched = cut_lineage(items.mapInPandas(_item_rows(s), ITEM_SHAPE))
    widths: dict[int, list[int]] = {}
    for r in sorted(searched.select("family", "width").distinct().collect()):  # at most 3 families of ``window`` widths
        widths.setdefault(r["family"], []).append(r["width"])
    rows = docs.select("doc_id", text_hash().alias("_h"), "text")
    found = rows.mapInPandas(_text_rows(s, widths, key_filter(searched, "key", s.filter_bits)),
                             "doc_id long, _h long, key long, _at int, _said array<string>")
    counted = ["in_plain", "in_named", "n_plain", "n_named", "n_all"]
    joined = searched.join(found, "key").select(
        "doc_id", "_h", "item_id", "_t", "pos", *counted, F.when(F.col("_at") >= 0, F.col("_at") - F.col("pos")).alias("shift"),
        F.arrays_zip(F.col("slots").alias("i"), F.col("_said").alias("d"), F.col("opens").alias("o")).alias("values"))
    pair = ["doc_id", "_h", "item_id", "_t"]
    aligned = cut_lineage(joined)
    values = aligned.select(*pair, "shift", F.explode("values").alias("v")).select(*pair, "shift", "v.i", "v.d", "v.o")
    single = values.groupBy(*pair, "shift", "i", "d").agg(F.min("o").alias("o")).groupBy(*pair, "shift", "i").agg(
        F.count("*").alias("n"), F.max(F.col("d") != F.col("i")).alias("other"), F.min("o").alias("o"))
    # an opening that both sides share is a plain word, and no value that has stayed the same
    judged = single.groupBy(*pair, "shift").agg(
        F.avg(F.when(~F.col("o") | F.col("other"), (F.col("n") == 1).cast("int"))).alias("_single"), F.max("other").alias("_other"))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate([*pair, "shift"])]
    known = judged.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*pair, "shift"])], "_single", "_other")
    condition = same[0] & same[1] & same[2] & same[3] & same[4]
    good = aligned.drop("values").join(known, condition, "left").where(
        F.coalesce("_single", F.lit(1.0)) >= s.consistent)
    per = good.groupBy(*pair).agg(
        *[F.countDistinct(F.when(F.col(f"in_{c}"), F.col("pos"))).alias(f"m_{c}") for c in ("plain", "named")],
        F.countDistinct("pos").alias("m_all"), *[F.max(c).alias(c) for c in counted[2:]],
        F.countDistinct(F.when(~F.coalesce("_other", F.lit(False)), F.col("pos"))).alias("_own"))
    best = F.greatest(*[F.struct(F.coalesce(F.try_divide(f"m_{c}", f"n_{c}"), F.lit(0.0)).alias("coverage"),
                                 F.col(f"m_{c}").alias("matched"), F.col(f"n_{c}").alias("windows")) for c in ("plain", "named", "all")])
    return per.withColumn("best", best).select(
        "doc_id", "_h", "item_id", "best.matched", "best.windows", "best.coverage",
        (F.col("_own") == F.col("m_all")).alias("verbatim")).where(F.col("coverage") >= s.coverage)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, s: TemplateSettings = TemplateSettings()) -> DataFrame:
    """The rows of ``docs`` whose text leaks no benchmark item, with their columns."""
    of_text = free_name(docs, "_text")
    gone = find_leaks(docs.select("doc_id", "text"), benchmark, s).select(F.col("_h").alias(of_text)).distinct()
    return docs.join(gone, text_hash() == F.col(of_text), "left_anti")
