"""Line dedup over overlapping three-line windows, in DataFrame functions alone.

Every run of three consecutive lines (blank ones are passed over) is hashed to
128 bits; a window whose hash also starts earlier in the corpus is a repeat,
and the lines that repeats cover go, merged into spans.  Earlier means a
smaller doc_id (null last), then a smaller text hash, then an earlier line.
Windows are judged on the input, so overlapping repeats of one passage all go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import numbered, text_hash

WIDTH = 3
PLACE = ["_n", "_id", "_h"]


def _with_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    lines = F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))
    return docs.withColumns({
        "_n": F.col(doc_id).isNull(), "_id": F.coalesce(doc_id, F.lit(0)), "_h": text_hash(text), "_lines": lines})


def _windows(rows: DataFrame) -> DataFrame:
    """(place, start, a, b): one row per window, its start counted over lines that are not blank."""
    said = F.filter("_lines", lambda line: F.trim(line) != "")
    starts = F.when(F.size("_said") >= WIDTH, F.sequence(F.lit(0), F.size("_said") - WIDTH))

    def window(i):
        run = [F.get(F.col("_said"), i + k) for k in range(WIDTH)]
        return F.struct(i.alias("start"), F.xxhash64(*run).alias("a"), F.xxhash64(F.lit(1), *reversed(run)).alias("b"))

    exploded = rows.select(*PLACE, said.alias("_said")).select(*PLACE, F.explode(F.transform(starts, window)).alias("_w"))
    return exploded.select(*PLACE, "_w.*")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(place, start) of every window that is not the first of its kind."""
    windows = _windows(rows)
    place = F.struct(*PLACE, "start")
    firsts = (windows.groupBy("a", "b").agg(F.min(place).alias("_first"), F.count("*").alias("_times"))
              .where("_times > 1").drop("_times"))
    return windows.join(firsts, ["a", "b"]).where(place > F.col("_first")).select(*PLACE, "start")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with cleaned ``text``, plus n_lines, n_removed and n_spans.

    A null text stays null with no lines; an empty text is one blank line and
    stays.  Rows that repeat both id and text are one document: none of them is
    earlier than the other, and each gets the same result.  Blank lines inside
    a removed span go with it.  Input columns named like an output are replaced,
    any other name is kept with its values.
    """
    base, named = numbered(docs.drop("n_lines", "n_removed", "n_spans"))
    rows = _with_lines(base, named["doc_id"], named["text"])
    starts = repeated_windows(_with_lines(docs.select("doc_id", "text"))).groupBy(*PLACE).agg(
        F.array_sort(F.collect_set("start")).alias("_starts"))
    both = rows.join(starts, PLACE, "left").withColumn("_starts", F.coalesce("_starts", F.array().cast("array<int>")))
    # a span begins at a start that no earlier window reaches, and ends behind the last window of its chain
    begin = F.filter("_starts", lambda s, i: (i == 0) | (s - F.get(F.col("_starts"), i - 1) > WIDTH))
    end = F.filter("_starts", lambda s, i: (i == F.size("_starts") - 1) | (F.get(F.col("_starts"), i + 1) - s > WIDTH))
    both = both.withColumns({
        "_begin": begin, "_end": F.transform(end, lambda s: s + WIDTH - 1),
        "_at": F.filter(F.transform("_lines", lambda line, i: F.when(F.trim(line) != "", i)), lambda i: i.isNotNull())})
    both = both.withColumns({  # line numbers of each span's first and last line
        "_from": F.transform("_begin", lambda o: F.get(F.col("_at"), o)),
        "_to": F.transform("_end", lambda o: F.get(F.col("_at"), o))})
    gap_from = F.concat(F.array(F.lit(0)), F.transform("_to", lambda i: i + 1))
    gap_to = F.concat("_from", F.array(F.size("_lines")))
    kept = F.flatten(F.transform(F.arrays_zip(gap_from.alias("f"), gap_to.alias("t")),
                                 lambda g: F.slice("_lines", g["f"] + 1, g["t"] - g["f"])))
    cleaned = F.when(F.col(named["text"]).isNull(), F.lit(None)).otherwise(F.array_join("_kept", "\n"))
    columns = [(cleaned if name == "text" else F.col(c)).alias(name) for name, c in named.items()]
    return both.withColumn("_kept", kept).select(
        *columns, F.size("_lines").alias("n_lines"), (F.size("_lines") - F.size("_kept")).alias("n_removed"),
        F.size("_begin").alias("n_spans"))
