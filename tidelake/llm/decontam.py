"""Benchmark decontamination by winnowing.

Of each text's ``K``-word grams the least hash in every ``SLIDE`` grams in a row is kept. Texts that share
``K + SLIDE - 1`` words in a row share such a fingerprint at the same place of the span, so joining the fingerprints of documents
and items finds every shared span of ``WINDOW`` words or more; each hit is extended along its diagonal and the windows in
full agreement are marked. Items of fewer words are one window each, found by the hash of as many words.

Everything is DataFrame operations. Fingerprints of the benchmark are broadcast only if there are at most
``MOST_BROADCAST``; beyond that the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

K, SLIDE, WINDOW = 5, 6, 10
MOST_BROADCAST = 200_000
#: Words: runs of anything but ASCII that is no digit or letter (a fixed value).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: F.Column) -> F.Column:
    """The words of a text, A-Z lowered; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def let(value: F.Column, f) -> F.Column:  # noqa: ANN001
    """``f(value)`` with ``value`` evaluated once, however often ``f`` and lambdas within it use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def gram_hashes(hashes: F.Column, k: int) -> F.Column:
    """The hash of each ``k`` word hashes in a row (at least ``k`` must be there)."""
    return let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k)))))


def fingerprints(words: F.Column) -> F.Column:
    """The distinct hashes that winnowing keeps; none where there are fewer than WINDOW words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    least = let(gram_hashes(hashes, K), lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - SLIDE), lambda i: F.least(*(F.get(g, i + j) for j in range(SLIDE)))))
    return F.when(F.size(words) >= WINDOW, F.array_distinct(least)).otherwise(F.array().cast("array<long>"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, its words, and the places and hashes of its fingerprints (one of the whole item, if it is short)."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    placed = let(
        gram_hashes(hashes, K),
        lambda g: F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.size(g) - SLIDE),
                lambda i: F.array_min(F.array(*(F.struct(F.get(g, i + j).alias("hash"), (i + j).alias("at")) for j in range(SLIDE)))),
            )
        ),
    )
    # A short item is found by all its words: no gram of fewer is shared by chance.
    return words.withColumn("prints", F.when(F.size("words") >= WINDOW, placed)).withColumn("whole", F.when(F.size("words") < WINDOW, F.xxhash64(hashes)))


def _whole_grams(hashes: F.Column, n: int) -> F.Column:
    """The distinct hashes of ``n`` word hashes in a row, as _items() hashes a whole item."""
    return let(hashes, lambda h: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(F.slice(h, i, n)))))


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed documents (doc_id, text_hash, n_words, prints) and, for those with a hit, (doc_id, text_hash, n_hit, items)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    words = texts.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))
    signed = materialise(words.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), fingerprints(F.col("words")).alias("prints")), "prints")
    items = materialise(_items(benchmark), "items")
    size = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    small = F.broadcast if size <= MOST_BROADCAST else lambda df: df

    prints = items.where("whole IS NULL").select("item_id", F.explode("prints").alias("p")).select("item_id", F.col("p.hash").alias("hash")).distinct()
    near = signed.select("doc_id", "text_hash", F.explode("prints").alias("hash")).join(small(prints), "hash").select("doc_id", "text_hash", "item_id")
    whole = items.where("whole IS NOT NULL").select("item_id", F.size("words").alias("n"), "whole")
    lengths = sorted(r["n"] for r in whole.select("n").distinct().collect())  # at most WINDOW - 1
    if lengths:  # the grams of all these lengths in one pass over the texts
        hashed = words.select("doc_id", "text_hash", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
        grams = F.flatten(F.array(*(F.when(F.size("h") >= n, _whole_grams(F.col("h"), n)).otherwise(F.array().cast("array<long>")) for n in lengths)))
        near = near.union(hashed.select("doc_id", "text_hash", F.explode(grams).alias("whole")).join(small(whole), "whole").select("doc_id", "text_hash", "item_id"))
    found = near.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("item_id")).alias("found"))

    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("t"))
    held = texts.join(found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "found"), same).dropDuplicates(["doc_id", "text_hash"])
    pairs = held.select("doc_id", "text_hash", words_of(F.col("text")).alias("dw"), F.explode("found.item_id").alias("id"))
    pairs = pairs.join(small(items), F.col("id").eqNullSafe(F.col("item_id"))).withColumn("size", F.size("words"))

    # Diagonals: document place less item place of every shared fingerprint.
    grams = gram_hashes(F.transform("dw", lambda w: F.xxhash64(w)), K)
    by_print = let(grams, lambda g: F.flatten(F.transform(F.col("prints"), lambda p: F.transform(F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.get(g, i) == p["hash"]), lambda i: i - p["at"]))))
    by_first = F.filter(F.sequence(F.lit(0), F.size("dw") - F.col("size")), lambda i: F.get("dw", i) == F.get("words", F.lit(0)))
    diagonals = F.when(F.size("dw") < F.least("size", F.lit(WINDOW)), F.array().cast("array<int>")).when(F.col("whole").isNotNull(), by_first).otherwise(F.array_distinct(by_print))
    lines = pairs.select("doc_id", "text_hash", "item_id", "words", "size", F.explode(diagonals).alias("diagonal"), "dw")
    # Along a diagonal, the item's places where the texts agree; a window is hit where all its words do.
    lines = lines.select("doc_id", "text_hash", "item_id", "size", "diagonal", "words", F.slice("dw", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.col("size")).alias("span"))
    agree = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.get("span", i + F.least(F.col("diagonal"), F.lit(0))) == F.get("words", i), F.lit(False)))
    width = F.least(F.col("size"), F.lit(WINDOW))
    starts = let(agree, lambda a: F.filter(F.sequence(F.lit(0), F.col("size") - width), lambda i: ~F.array_contains(F.slice(a, i + 1, width), False)))
    covered = let(starts, lambda s: F.array_distinct(F.flatten(F.transform(s, lambda i: F.sequence(i + F.col("diagonal"), i + F.col("diagonal") + width - 1)))))
    marks = lines.select("doc_id", "text_hash", "item_id", F.explode(covered).alias("at")).distinct()
    places = marks.select("doc_id", "text_hash", "at").distinct().groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n_hit"))
    names = marks.groupBy("doc_id", "text_hash").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("items"))
    both = places.join(names.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}), same).select("doc_id", "text_hash", "n_hit", "items")
    return signed, both


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs`` (doc_id, text).

    A window is WINDOW words in a row of a row of ``benchmark`` (item_id, text), or all the words of a shorter one;
    a document's word inside any occurrence of a window is hit. A null text has no words, and an item without words has
    no window. A very long text is split and hashed whole. Rows that repeat doc_id and text get the same answer each; a null item_id counts as the empty string.
    Other columns don't matter; an empty table on either side gives no hit.
    """
    signed, found = hits(docs, benchmark)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("t"))
    out = signed.drop("prints").join(found.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}), same, "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns, whatever their names."""
    _, found = hits(docs, benchmark)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("d")) & F.xxhash64(F.col("row.text").cast("string")).eqNullSafe(F.col("t"))
    return rows.join(found, same, "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))
