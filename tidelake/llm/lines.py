"""Line deduplication over windows of three lines.

Every three lines in a row are a window. Of the windows that stand more than once in the corpus the first occurrence
(least doc_id, then place) stays; the lines that later occurrences cover are merged and removed. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialise
from .decontam import let

WINDOW_LINES = 3


def _windows(lines: F.Column) -> F.Column:
    """Two independent 64-bit hashes of each window, by place."""

    def one(v: F.Column, i: F.Column) -> F.Column:
        parts = [F.get(v, i + j) for j in range(WINDOW_LINES)]
        return F.struct(F.xxhash64(*parts).alias("w1"), F.xxhash64(F.lit(7), *reversed(parts)).alias("w2"))

    every = let(lines, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - WINDOW_LINES), lambda i: one(v, i)))
    return F.when(F.size(lines) >= WINDOW_LINES, every)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, hash, lines, and the whole row. Two rows are one document where doc_id and text agree; a null doc_id comes last, a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("hash"), F.split(text, "\n").alias("lines"))


def removed_places(docs: DataFrame) -> DataFrame:
    """doc, hash and the sorted places of the lines to remove, for documents that lose any."""
    found = _keyed(docs.select("doc_id", "text")).select("doc", "hash", F.posexplode(_windows(F.col("lines"))).alias("at", "w"))
    found = materialise(found.select("doc", "hash", "at", "w.w1", "w.w2"), "windows")
    spot = F.struct(F.col("doc").isNull().alias("z"), "doc", "hash", "at")
    # Both sums are made before rows move, so a window that a third of the corpus holds costs a row for each task.
    first = materialise(found.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("first")).where("n > 1"), "first")
    later = join_counted(found, first, ["w1", "w2"], "n").where(~spot.eqNullSafe(F.col("first")))
    covered = later.select("doc", "hash", F.explode(F.sequence(F.col("at"), F.col("at") + WINDOW_LINES - 1)).alias("at")).distinct()
    return covered.groupBy("doc", "hash").agg(F.array_sort(F.collect_list("at")).alias("gone"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with all columns, the text without its repeated lines, and n_lines and n_removed beside.

    Lines part at "\\n"; a text of fewer than three lines has no window and stays as it is, and a null text stays null
    (one empty line, counted as such). Rows that repeat doc_id and text count as one document: each of them loses the same lines.
    Columns of ``docs`` named n_lines or n_removed are replaced; other columns don't matter, whatever their names. A very
    long text is split whole, in time linear in its lines. An empty table gives an empty result.
    """
    gone = removed_places(docs).withColumnsRenamed({"doc": "d", "hash": "h"})
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))
    rows = _keyed(docs).join(gone, same, "left")
    # Runs of lines that stay: between one removed place and the next, so the work is linear in the lines.
    edges = F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("lines")))
    left = let(edges, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.slice("lines", F.get(e, i) + 2, F.get(e, i + 1) - F.get(e, i) - 1))))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    own = [text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return rows.select(*own, F.size("lines").cast("long").alias("n_lines"), removed.alias("n_removed"))
