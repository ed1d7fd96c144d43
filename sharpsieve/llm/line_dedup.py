"""Line dedup by overlapping windows of consecutive lines, with DataFrame functions only.

A document's lines are its text split at line feeds. Every window of `window`
consecutive lines is hashed (two 64-bit hashes). A window found more than once in
all documents keeps its first occurrence (order: doc_id, nulls last; text hash;
position); the lines that any later occurrence covers are merged into spans and
removed. A removed line's text is always kept somewhere earlier.

Defined results: a null text stays null and has 0 lines; a text of fewer than
`window` lines has no window and stays; windows of blank lines only don't count;
rows that repeat both doc_id and text are one document, so each repeats its
result; a null doc_id is an id like any other; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sharpsieve.llm.common import free_name


def _windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """id, th, pos, h1, h2 for each window that isn't blank."""
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.split(text_col, "\n", -1).alias("lines")).where(F.size("lines") >= window)

    def at(i: Column) -> Column:
        own = [F.get("lines", i + k) for k in range(window)]
        blank = own[0].rlike(r"^\s*$")
        for x in own[1:]:
            blank = blank & x.rlike(r"^\s*$")
        return F.when(~blank, F.struct(i.cast("int").alias("pos"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(window), *reversed(own)).alias("h2")))

    hashed = F.transform(F.sequence(F.lit(0), F.size("lines") - window), at)
    return lines.select("id", "th", F.explode(hashed).alias("w")).where("w is not null").select("id", "th", "w.pos", "w.h1", "w.h2")


def removed_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """id, th, spans: the merged spans (first and last line, from 0) to remove from each document that has any."""
    found = _windows(docs, id_col, text_col, window)
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("th"), F.col("pos"))
    first = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("id", "th", "pos").distinct()
    own = W.partitionBy("id", "th").orderBy("pos")
    opens = later.select("*", (F.col("pos") - F.lag("pos", 1).over(own)).alias("gap"))
    opens = opens.select("id", "th", "pos", F.sum(F.when(F.col("gap") <= window, 0).otherwise(1)).over(own).alias("k"))
    spans = opens.groupBy("id", "th", "k").agg(F.min("pos").alias("a"), (F.max("pos") + window - 1).alias("b"))
    return spans.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """docs with the text that is kept, and the columns n_lines and n_removed (underscores in front if taken)."""
    n_lines, n_removed = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    spans = removed_spans(docs, id_col=id_col, text_col=text_col, window=window).select(F.col("id").alias("_cut_id"), F.col("th").alias("_cut_th"), F.col("spans").alias("_cut_spans"))
    both = docs.join(spans, F.col("_cut_id").eqNullSafe(docs[id_col]) & (F.col("_cut_th") == F.xxhash64(docs[text_col])), "left")
    both = both.withColumn("_cut_lines", F.when(F.col("_cut_spans").isNotNull(), F.split(text_col, "\n", -1)))

    def gap(s: Column, i: Column) -> Column:
        """The lines between the span before and this one."""
        start = F.when(i == 0, 0).otherwise(F.get("_cut_spans", i - 1)["b"] + 1)
        return F.slice("_cut_lines", start + 1, s["a"] - start)

    last = F.get("_cut_spans", F.size("_cut_spans") - 1)["b"]
    tail = F.slice("_cut_lines", last + 2, F.size("_cut_lines"))
    kept = F.array_join(F.concat(F.flatten(F.transform("_cut_spans", gap)), tail), "\n")
    lost = F.aggregate("_cut_spans", F.lit(0), lambda a, s: a + s["b"] - s["a"] + 1)
    count = F.coalesce(F.length(F.regexp_replace(text_col, "[^\n]+", "")) + 1, F.lit(0))
    return both.select(
        *[F.when(F.col("_cut_spans").isNull(), docs[text_col]).otherwise(kept).alias(c) if c == text_col else docs[c] for c in docs.columns],
        count.cast("long").alias(n_lines),
        F.coalesce(F.when(F.col("_cut_spans").isNotNull(), lost), F.lit(0)).cast("long").alias(n_removed),
    )
