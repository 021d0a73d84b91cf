"""Stupid-backoff language-model scores, computed relationally.

n-grams are exploded into rows and counted into tables partitioned by hash; the documents' n-grams are joined to the
count tables, and the logarithms are summed per document.

Where the documents are the corpus, the rows that are counted are those that are joined, so they are dealt once, by
the hash of the words before the last: a partition gets a context and all that follows it, counts both, joins its rows
and sums them per document. The most frequent n-grams and contexts, at most ``MOST_HOT``, are counted first and met by
a table in every task, so that no task gets all rows of one. All rows at once would fill the disks, so the hash space is
worked off in ``PASSES`` parts, each dealt, counted, joined, summed and dropped before the next.

Another corpus is counted in as many parts; its most frequent n-grams are dealt by n-gram and salt. The keys of the
count tables are unique, so their shuffle partitions are even, and each is held as a hash table in the join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, discard, join_counted, map_rows, materialise, mix64, no_shuffle_files_left, utf8

ORDER, ALPHA, PASSES = 3, 0.4, 8
#: n-grams that are salted: the most frequent ones of a part, each in at least ``LEAST_HOT`` places.
MOST_HOT, LEAST_HOT, SALTS = 20_000, 1_000, 64
SALT_SHIFT = 58
#: Where the documents are the corpus: places looked at for frequent n-grams, and in how many of these one stands.
SAMPLED, LEAST_SAMPLED = 1 << 20, 20
#: Exploded rows that a partition holds at once.
PARTITION_ROWS = 1_000_000
#: Words that are exploded at once.
SLICE_WORDS = 1 << 19
_rng = np.random.default_rng(7)
WEIGHTS = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * U64(2) + U64(1)


def gram_keys(words: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n up to ``order``, the 64-bit keys of the n-grams (of word hashes) that begin at words 0, 1, ..."""
    out, key = [], np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        m = max(0, len(words) - n + 1)
        key = mix64(key[:m] * WEIGHTS[0] + words[n - 1 : n - 1 + m] + WEIGHTS[n])
        out.append(key)
    return out


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, key (of doc_id and text), n_words and the words' hashes in a row, of each row of ``docs``."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        hashes = WordHashes()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [hashes.array(t.lower().split()) for t in batch.column(2).to_pylist()]
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(map(len, words), pa.int64()), pa.array([w.tobytes() for w in words], pa.binary())], names=["doc_id", "key", "n_words", "words"])

        return f

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", utf8()).alias("key"), utf8().alias("text"))
    return map_rows(rows, make, "doc_id long, key long, n_words long, words binary")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents of a batch at a time: their keys, their words in a row (not copied), and each one's number of words; documents without words are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col, keys = batch.column("words"), batch.column("key").to_numpy()
        _, offsets, data = col.buffers()
        ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1] // 8
        row, sizes, i = np.frombuffer(data or b"", np.uint64, int(ends[-1])), np.diff(ends), 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE_WORDS, side="right")) - 1)
            full = sizes[i:j] > 0
            if full.any():
                yield keys[i:j][full], row[ends[i] : ends[j]], sizes[i:j][full]
            i = j


def _within(sizes: np.ndarray, n: int) -> np.ndarray:
    """Of all places where n words in a row begin, those where they are of one document."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(ends))
    return np.flatnonzero(at + n <= ends)


def counted(words: DataFrame, order: int, part: int, parts: int) -> DataFrame:
    """The count table (gram, n) of one part of the hash space: all n-grams up to ``order``, exploded and summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row, sizes in slices(batches):
            every = [k[_within(sizes, n)] for n, k in enumerate(gram_keys(row, order), 1)]
            grams, n = np.unique(np.concatenate([k[k % U64(parts) == part] for k in every]), return_counts=True)
            if len(grams):
                yield pa.record_batch([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return words.select("key", "words").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Hot:
    """The frequent n-grams (sorted) and the logarithms of their counts: a count table that every task holds."""

    BITS = 20

    def __init__(self, grams: np.ndarray, n: np.ndarray) -> None:
        by = np.argsort(grams)
        self.grams, self.logs = grams[by], np.log(n[by])
        self.flags = np.zeros(1 << self.BITS, bool)
        self.flags[self.grams & U64((1 << self.BITS) - 1)] = True

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Where each n-gram stands in the table, or -1."""
        out = np.full(len(grams), -1, np.int32)
        maybe = np.flatnonzero(self.flags[grams & U64((1 << self.BITS) - 1)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
            same = self.grams[at] == grams[maybe]
            out[maybe[same]] = at[same]
        return out


def _tally(words: DataFrame, orders: range, choose: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(gram, n): how often each n-gram of these orders stands in ``words``, of those that the function made by ``choose`` picks from the ones of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = choose()
        for _, row, sizes in slices(batches):
            by_n = gram_keys(row, orders[-1])
            grams, n = np.unique(np.concatenate([pick(by_n[k - 1][_within(sizes, k)]) for k in orders]), return_counts=True)
            if len(grams):
                yield pa.record_batch([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return words.select("key", "words").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _table(rows: DataFrame) -> Hot:
    got = rows.collect()
    return Hot(np.array([r["gram"] for r in got], np.int64).view(np.uint64), np.array([r["n"] for r in got], np.int64))


def frequent(words: DataFrame, order: int, total: int) -> Hot:
    """The exact counts of the n-grams and contexts that are frequent in a sample of about ``SAMPLED`` places.

    The sample only says which n-grams are dealt otherwise; scores are the same whatever it holds.
    """
    orders, step = range(max(1, order - 1), order + 1), max(1, total // SAMPLED)

    def some() -> Callable[[np.ndarray], np.ndarray]:
        rng = np.random.default_rng(7)
        return lambda grams: grams[int(rng.integers(step)) :: step]

    names = _table(_tally(words, orders, some).where(F.col("n") >= LEAST_SAMPLED).orderBy(F.desc("n"), "gram").limit(MOST_HOT))
    if not len(names.grams):
        return names
    return _table(_tally(words, orders, lambda: lambda grams: grams[names.find(grams) >= 0]))


#: What a row adds to its document's score: so many logarithms of its n-gram's count, and of its context's count.
GRAM_WEIGHT, CONTEXT_WEIGHT = np.array([1, 1, 0, 0, 0]), np.array([-1, 0, -1, 0, 1])
BOTH, GRAM_ONLY, CONTEXT_OFF, COUNTED, CONTEXT_ADDED = range(5)


def _places(sizes: np.ndarray, by_n: list[np.ndarray], order: int, hot: Hot) -> tuple[np.ndarray, ...]:
    """For each place of an n-gram of the ``order``: place, n-gram, context, where these stand in ``hot``, and whether its document begins there."""
    at = _within(sizes, order)
    starts = np.zeros(int(sizes.sum()), bool)
    starts[np.cumsum(sizes) - sizes] = True
    grams = by_n[order - 1][at]
    context = by_n[order - 2][at] if order > 1 else grams
    return at, grams, context, hot.find(grams), hot.find(context), starts[at]


def _last_contexts(sizes: np.ndarray, by_n: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts that no word follows: document, context, and whether it is the whole document."""
    docs = np.flatnonzero(sizes >= order - 1) if order > 1 else np.zeros(0, np.int64)
    return docs, by_n[max(0, order - 2)][np.cumsum(sizes)[docs] - (order - 1)], sizes[docs] == order - 1


def exploded(words: DataFrame, order: int, part: int, parts: int, hot: Hot) -> DataFrame:
    """(deal, gram, key, role): a row for each n-gram of the ``order``, dealt by its context, and for each context at a document's end.

    So a context and all that follows it are in one partition, which counts both. The word at place i scores log c(the
    ``order`` words up to i) - log c(the order - 1 before i). The first words have fewer before them, and their terms
    cancel but for the first order - 1 words in a row, which in turn cancel with what the first word with order - 1
    before it takes off. Frequent contexts are not dealt, and what follows them is dealt by n-gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, sizes in slices(batches):
            of, by_n = np.repeat(np.arange(len(sizes)), sizes), gram_keys(row, order)
            at, grams, context, known, known_context, first = _places(sizes, by_n, order, hot)
            alone = (known_context >= 0) | (order == 1)
            deal = np.where(alone, grams, context)
            own = np.flatnonzero((deal % U64(parts) == part) & ~(alone & (known >= 0)))
            no_gram, no_context = known[own] >= 0, alone[own] | first[own]
            role = np.where(no_gram, np.where(no_context, COUNTED, CONTEXT_OFF), np.where(no_context, GRAM_ONLY, BOTH))
            docs, last, whole = _last_contexts(sizes, by_n, order)
            ends = np.flatnonzero((last % U64(parts) == part) & (hot.find(last) < 0))
            key = np.concatenate([keys[of[at[own]]], keys[docs[ends]]])
            deal = np.concatenate([deal[own], last[ends]])
            gram = np.concatenate([np.where(no_gram, context[own], grams[own]), last[ends]])
            role = np.concatenate([role, np.where(whole[ends], CONTEXT_ADDED, COUNTED)]).astype(np.int8)
            if len(key):
                yield pa.record_batch([pa.array(deal.view(np.int64)), pa.array(gram.view(np.int64)), pa.array(key), pa.array(role)], names=["deal", "gram", "key", "role"])

    return words.select("key", "words").mapInArrow(run, "deal long, gram long, key long, role tinyint")


def counted_and_joined(rows: DataFrame, partitions: int) -> DataFrame:
    """(key, s): exploded() rows, dealt by hash; each partition counts its contexts and n-grams in hash tables, joins its rows to these, and sums per document."""

    def logs(col: pa.Array) -> np.ndarray:
        at = pc.dictionary_encode(col).indices.to_numpy()
        return np.log(np.bincount(at))[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        deal, gram, key, role = (t.column(c).chunk(0) for c in ("deal", "gram", "key", "role"))
        role = role.to_numpy()
        s = GRAM_WEIGHT[role] * logs(gram) + CONTEXT_WEIGHT[role] * logs(deal)
        some = pa.array(s != 0)  # an n-gram that always follows its context adds nothing
        left = pa.table({"key": key, "s": s}).filter(some)
        yield from pa.TableGroupBy(left, "key", use_threads=False).aggregate([("s", "sum")]).rename_columns(["key", "s"]).to_batches()

    return rows.repartition(partitions, "deal").mapInArrow(run, "key long, s double")


def frequent_sums(words: DataFrame, order: int, hot: Hot) -> DataFrame:
    """(key, s): what the frequent n-grams and contexts add to each document's score; their count table goes to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, sizes in slices(batches):
            of, by_n = np.repeat(np.arange(len(sizes)), sizes), gram_keys(row, order)
            at, _, _, known, known_context, first = _places(sizes, by_n, order, hot)
            docs, last, whole = _last_contexts(sizes, by_n, order)
            known_last = hot.find(last)
            plus, off, added = known >= 0, (known_context >= 0) & ~first & (order > 1), (known_last >= 0) & whole
            s = np.bincount(of[at[plus]], hot.logs[known[plus]], len(sizes)) - np.bincount(of[at[off]], hot.logs[known_context[off]], len(sizes))
            s += np.bincount(docs[added], hot.logs[known_last[added]], len(sizes))
            some = np.flatnonzero(s)
            yield pa.record_batch([pa.array(keys[some]), pa.array(s[some])], names=["key", "s"])

    return words.select("key", "words").mapInArrow(run, "key long, s double")


def short_sums(words: DataFrame, order: int) -> DataFrame | None:
    """(key, s) of the documents of fewer than ``order`` - 1 words: the logarithm of how often all their words stand in a row anywhere."""
    few = words.where((F.col("n_words") > 0) & (F.col("n_words") < order - 1))
    if few.isEmpty():
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, sizes in slices(batches):
            by_n, first = gram_keys(row, order), np.cumsum(sizes) - sizes
            for n in range(1, order - 1):
                own = sizes == n
                yield pa.record_batch([pa.array(keys[own]), pa.array(by_n[n - 1][first[own]].view(np.int64))], names=["key", "gram"])

    asked = materialise(few.select("key", "words").mapInArrow(run, "key long, gram long"), "asked")
    names = asked.select("gram").distinct()
    wanted = np.array([r["gram"] for r in names.limit(MOST_HOT + 1).collect()], np.int64).view(np.uint64)
    if len(wanted) <= MOST_HOT:
        table = Hot(wanted, np.ones(len(wanted)))
        counts = _tally(words, range(1, order - 1), lambda: lambda grams: grams[table.find(grams) >= 0])
    else:
        counts = _tally(words, range(1, order - 1), lambda: lambda grams: grams).join(names, "gram", "left_semi")
    counts = materialise(counts, "counts")
    out = materialise(join_counted(asked, counts, ["gram"], "n").groupBy("key").agg(F.sum(F.log("n")).alias("s")), "sums")
    discard(asked, counts)
    return out


def _hot(counts: DataFrame) -> np.ndarray:
    return np.array([r["gram"] for r in counts.where(F.col("n") >= LEAST_HOT).orderBy(F.desc("n")).limit(MOST_HOT).collect()], np.int64)


def _dealt(gram: str, salt: F.Column) -> F.Column:
    """The key by which rows of an n-gram meet the count table: with the salt in its highest bits."""
    return F.col(gram).bitwiseXOR(F.shiftleft(salt.cast("long"), SALT_SHIFT))


def _salted(counts: DataFrame, hot: np.ndarray) -> DataFrame:
    """The count table with a row for each salt of a hot n-gram, else for salt 0."""
    keys = counts.sparkSession.createDataFrame([(int(g),) for g in hot], "gram long")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    every = counts.join(F.broadcast(keys.withColumn("hot", F.lit(True))), "gram", "left").select("gram", "n", F.explode(salts).alias("salt"))
    return every.select(_dealt("gram", F.col("salt")).alias("gram"), "n").hint("shuffle_hash")


def own_sums(words: DataFrame, order: int, total: int, passes: int) -> DataFrame:
    """(key, s): per document the weighted logarithms of its n-grams' counts, where the documents are the corpus."""
    spark = words.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (passes * PARTITION_ROWS)))
    with no_shuffle_files_left(spark):
        hot, short = frequent(words, order, total), short_sums(words, order)
        every = materialise(frequent_sums(words, order, hot), "sums") if len(hot.grams) else None
        for part in range(passes):
            rows = exploded(words, order, part, passes, hot)
            sums = materialise(counted_and_joined(rows, partitions).groupBy("key").agg(F.sum("s").alias("s")), "sums")
            every = sums if every is None else every.union(sums)
    return every if short is None else every.union(short)


def backed_off_sums(words: DataFrame, corpus: DataFrame, order: int, total: int, alpha: float, passes: int) -> DataFrame:
    """(key, s): per document the scores of its words by another corpus, each by the longest n-gram that the corpus has."""
    spark, out = words.sparkSession, []

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word's n-grams that end at it, longest first; the context of one begins where it does."""
        for keys, row, sizes in slices(batches):
            of, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            by_n = gram_keys(row, order)
            for i in range(0, len(row), 1 << 16):
                grams, contexts = [], []
                for p in range(i, min(len(row), i + (1 << 16))):
                    most = min(order, p - int(first[of[p]]) + 1)
                    grams.append([int(by_n[n - 1][p - n + 1].view(np.int64)) for n in range(most, 0, -1)])
                    contexts.append([int(by_n[n - 2][p - n + 1].view(np.int64)) for n in range(most, 1, -1)])
                key = keys[of[i : i + (1 << 16)]]
                yield pa.record_batch([pa.array(key), pa.array(grams, pa.list_(pa.int64())), pa.array(contexts, pa.list_(pa.int64()))], names=["key", "grams", "contexts"])

    todo = materialise(words.select("key", "words").mapInArrow(chains, "key long, grams array<long>, contexts array<long>"), "chains")
    tables = [materialise(counted(corpus, order, part, passes), "counts") for part in range(passes)]
    counts = tables[0]
    for more in tables[1:]:
        counts = counts.union(more)
    hot = _hot(counts)
    counts = _salted(counts, hot)
    keys = F.broadcast(spark.createDataFrame([(int(g),) for g in hot], "gram long").withColumn("hot", F.lit(True)))

    def looked_up(rows: DataFrame, name: str) -> DataFrame:
        salt = F.when(F.col("hot"), F.pmod("key", F.lit(SALTS)).cast("int")).otherwise(0)
        rows = rows.withColumn("gram", F.col(name)).join(keys, "gram", "left").withColumn("gram", _dealt("gram", salt)).drop("hot")
        return rows.join(counts.withColumnRenamed("n", f"n_{name}"), "gram", "left").drop("gram")

    for _ in range(order):  # the longest n-gram left of each chain
        rows = looked_up(todo.select("key", "grams", "contexts", F.get("grams", F.lit(0)).alias("g"), F.get("contexts", F.lit(0)).alias("c")), "g")
        seen = looked_up(rows.where("n_g IS NOT NULL").select("key", "c", "n_g"), "c")
        value = F.log("n_g") - F.when(F.col("c").isNull(), F.lit(math.log(max(total, 1)))).otherwise(F.log("n_c"))
        out.append(materialise(seen.groupBy("key").agg(F.sum(value).alias("s")), "sums"))
        unseen = rows.where("n_g IS NULL")
        last = F.when(F.size("grams") == 1, math.log(0.5 / max(total, 1))).otherwise(math.log(alpha))
        out.append(materialise(unseen.groupBy("key").agg(F.sum(last).alias("s")), "sums"))
        rest = materialise(unseen.where(F.size("grams") > 1).select("key", F.slice("grams", 2, order).alias("grams"), F.slice("contexts", 2, order).alias("contexts")), "chains")
        discard(todo)
        todo = rest
    discard(todo, *tables)
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every


def score(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, alpha: float = ALPHA, passes: int = PASSES) -> DataFrame:
    """doc_id, n_words, logprob (sum of natural logarithms over the words) and score (their mean) of each row of ``docs``.

    Counts are of all whole texts of ``corpus`` (doc_id, text), or of ``docs`` itself; then every n-gram has been seen,
    and no word backs off. Words part at ASCII white space, A-Z lowered. A word after its ``order - 1`` words before
    scores count(all) / count(before) if that is seen, else ``alpha`` times its score after one word less; alone,
    count / all words, where an unseen word counts as half of one. The first words of a text have fewer words before
    them. A null or empty text has no words: logprob 0, score null. Rows that repeat are counted and scored each. A very
    long text is hashed as a whole by one task, some megabytes for a million words. n-grams and rows (doc_id and text)
    are known by 64-bit hashes. Other columns don't matter; an empty table gives an empty result.
    """
    words = materialise(hashed(docs), "words")
    known = words if corpus is None else materialise(hashed(corpus), "words")
    total = known.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    sums = own_sums(words, order, total, passes) if corpus is None else backed_off_sums(words, known, order, total, alpha, passes)
    # Rows that repeat share a key: each of them has its part of the sum.
    copies = words.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    by_key = sums.groupBy("key").agg(F.sum("s").alias("s")).join(copies, "key").select("key", (F.col("s") / F.col("copies")).alias("s"))
    out = words.select("doc_id", "key", "n_words").join(by_key, "key", "left")
    each = F.col("n_words") if order == 1 else F.lit(1)
    s = F.coalesce("s", F.lit(0.0)) - (F.lit(0.0) if corpus is not None else F.when(F.col("n_words") > 0, each * math.log(max(total, 1))).otherwise(0.0))
    return out.select("doc_id", "n_words", s.alias("logprob"), F.when(F.col("n_words") > 0, s / F.col("n_words")).alias("score"))
