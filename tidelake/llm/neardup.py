"""Near-duplicate detection: MinHash bands, odd sketches, exact verification.

A document is its set of 5-word shingles. Documents with the same set are one node. MinHash samples give ``BANDS`` band
keys (candidates share one) and an odd sketch: a bitmap into which the samples are folded by parity, so that the
population count of two sketches' XOR estimates their similarity, most precisely where it is high. A second sketch folds
the whole set in the same way, which is more precise still for sets of some hundreds. Pairs whose sketches are far apart are dropped; the rest is verified on the full sets.

A band may hold a third of all rows, so its pairs are never all emitted. First each member is held against one pivot
of its band; then, over what is not yet connected, against its likeliest partner by sketch; last, all pairs that are
still in different components and whose sketches are near. Sketches are compared in tiles of a band, those outside its
largest component with all, so a large band is spread over many tasks; a pair counts in the first band that it shares
only. A similar pair is lost only if no band of it agrees: (1 - 0.75^4)^32 = 5e-6 at the limit, or by its sketches
(6 and 4.5 standard deviations); these drop none where the caller asks for ``exact``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, discard, map_rows, materialise, mix64, small_batches, utf8
from .graph import components

WIDTH, BANDS, ROWS, SKETCH_BITS = 5, 32, 4, 512
PERCENT = 75
#: Pairs whose estimate is below this share less than PERCENT for certain: 6 standard errors of 128 samples lie between.
LEAST_ESTIMATE = 0.5
TILE = 512

_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
WEIGHTS = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * U64(2) + U64(1)
SKETCH = [f"o{i}" for i in range(SKETCH_BITS // 64)]
#: A second odd sketch, of the whole set in place of samples: for sets of some hundreds it tells far more exactly.
PARITY_BITS = 1024
PARITY = [f"p{i}" for i in range(PARITY_BITS // 64)]


def shingles(data: bytes, words: WordHashes) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a whole text (UTF-8), in order; words part at ASCII white space, A-Z lowered."""
    h = words.array(data.lower().split())
    if not len(h):
        return h
    if len(h) < WIDTH:
        s = np.array([len(h)], np.uint64)
        for x in h:
            s = mix64(s * WEIGHTS[0] + x)
        return s
    s = sum((h[i : len(h) - WIDTH + 1 + i] * WEIGHTS[i] for i in range(1, WIDTH)), h[: len(h) - WIDTH + 1] * WEIGHTS[0])
    return np.unique(mix64(s))


def signature(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set."""
    small = (s ^ (s >> U64(32))).astype(np.uint32)
    out = np.full(len(MULTIPLY), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(small), 2048):
        np.minimum(out, (small[at : at + 2048, None] * MULTIPLY + ADD).min(axis=0), out=out)
    return out


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parity bits as 64-bit integers: each sample toggles the bit that it hashes to."""
    place = mix64(sig.astype(np.uint64) | (np.arange(len(sig), dtype=np.uint64) << U64(32))) % U64(SKETCH_BITS)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(bool), bitorder="little").view(np.int64)


def parity_sketch(s: np.ndarray) -> np.ndarray:
    place = (s >> U64(20)) % U64(PARITY_BITS)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=PARITY_BITS) & 1).astype(bool), bitorder="little").view(np.int64)


def parity_limits(most: int = 1024) -> np.ndarray:
    """For m elements that differ, the XOR population count of parity sketches that is 4.5 standard deviations above its mean (3e-6 exceed it)."""
    m, n = np.arange(most + 1), PARITY_BITS
    two, four = (1 - 2 / n) ** m, (1 - 4 / n) ** m
    mean, var = n * (1 - two) / 2, n * (1 - two**2) / 4 + n * (n - 1) * (four - two**2) / 4
    return np.minimum(n, np.ceil(mean + 4.5 * np.sqrt(np.maximum(var, 0)))).astype(np.int64)


LIMITS = parity_limits()


def most_apart(total: object) -> object:
    """The most elements that sets of ``total`` elements together may differ by and still be linked."""
    return total * (100 - PERCENT) // (100 + PERCENT)


def most_differing(estimate: float = LEAST_ESTIMATE) -> int:
    """The XOR population count that means this similarity."""
    gone = 2 * len(MULTIPLY) * (1 - estimate)
    return int(SKETCH_BITS / 2 * (1 - np.exp(-2 * gone / SKETCH_BITS)))


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key * WEIGHTS[i] + parts[:, i])
    return key.view(np.int64)


SIGNED = "doc_id long, text_hash long, n_shingles long, set_id binary, bands array<long>, " + ", ".join(f"{o} long" for o in SKETCH + PARITY)


def sign(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its doc_id and a hash of its text, the size and digest of its set, its band keys and its odd sketches."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        words = WordHashes()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, sets, bands, odd = [], [], [], []
            for data in batch.column(2).to_pylist():
                s = shingles(data or b"", words)
                n.append(len(s))
                sets.append(xxh3_128_digest(s.tobytes()))
                sig = signature(s)
                bands.append(band_keys(sig) if len(s) else [])
                odd.append(np.concatenate([odd_sketch(sig), parity_sketch(s)]))
            cols = np.array(odd, dtype=np.int64).reshape(-1, len(SKETCH + PARITY)).T
            return pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *map(pa.array, cols)],
                names=["doc_id", "text_hash", "n_shingles", "set_id", "bands", *SKETCH, *PARITY],
            )

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.xxhash64(utf8()), utf8().alias("text")), make, SIGNED)


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """set_id and its hashes for the ``nodes`` (set_id, doc_id), from the texts."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        words = WordHashes()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = {}
            for want, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = shingles(data or b"", words).tobytes()
                if xxh3_128_digest(raw) == want:  # rows may repeat a doc_id with another text
                    rows[want] = raw
            return pa.record_batch([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.binary())], names=["set_id", "hashes"])

        return f

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), utf8().alias("text"))
    return map_rows(nodes.join(texts, F.col("doc_id").eqNullSafe(F.col("id"))).select("set_id", "text"), make, "set_id binary, hashes binary")


def _verify(pairs: DataFrame, light: DataFrame, full: DataFrame, exact: bool) -> DataFrame:
    """The ``pairs`` (a, b) that are similar: sizes and (unless ``exact``) sketches first, then the full sets."""
    def side(x: str) -> DataFrame:
        return light.select(F.col("set_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), *(F.col(o).alias(f"{o}_{x}") for o in SKETCH + PARITY))

    def differing(names: list[str]) -> F.Column:
        return sum((F.bit_count(F.col(f"{o}_a").bitwiseXOR(F.col(f"{o}_b"))) for o in names), F.lit(0))

    apart = F.floor((F.col("n_a") + F.col("n_b")) * (100 - PERCENT) / (100 + PERCENT)).cast("int")
    limit = F.get(F.lit(LIMITS.tolist()), F.least(apart, F.lit(len(LIMITS) - 1)))
    alike = F.lit(True) if exact else (differing(SKETCH) <= most_differing()) & ((apart >= len(LIMITS)) | (differing(PARITY) <= limit))
    near = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(alike & (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))).select("a", "b")
    both = near.join(full.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), "a").join(full.select(F.col("set_id").alias("b"), F.col("hashes").alias("y")), "b")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                ok.append(100 * shared >= PERCENT * (len(p) + len(q) - shared))
            return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return f

    return materialise(map_rows(both.select("a", "b", "x", "y"), make, "a binary, b binary"), "links")


def _tile_pairs(open_members: DataFrame, best_only: bool, exact: bool) -> DataFrame:
    """Pairs (a, b) within a band whose sketches are near (or all, if ``exact``) and components differ: all, or each member's nearest one.

    Members of a band's largest component (n_in of them) are chunks 0, 1, ..., the others (n_out) follow. Pairs within
    that component don't matter, so only tiles with a chunk of others are made: n_out * (n_in + n_out) pairs are
    looked at, not the square of the band.
    """
    inside, outside = (F.ceil(F.col(n) / TILE).cast("int") for n in ("n_in", "n_out"))
    is_in = F.col("comp") == F.col("main")
    chunk = F.when(is_in, F.pmod(F.xxhash64("set_id"), inside)).otherwise(inside + F.pmod(F.xxhash64("set_id"), outside)).cast("int")
    first = F.when(is_in, inside).otherwise(0)  # with which chunks a member's own makes a tile
    tiles = open_members.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(first, inside + outside - 1)))
    tiles = tiles.select("band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).alias("second"), "set_id", "comp", "n_shingles", "bands", *SKETCH, *PARITY)
    limit = SKETCH_BITS if exact else most_differing()
    limits = np.full_like(LIMITS, PARITY_BITS) if exact else LIMITS

    def one(rows: pa.Table) -> list[tuple[bytes, bytes]]:
        ids, comp = rows.column("set_id").to_pylist(), rows.column("comp").to_pylist()
        number = {c: i for i, c in enumerate(dict.fromkeys(comp))}
        if len(number) < 2:
            return []
        comp = np.array([number[c] for c in comp])
        odd, parity = (np.stack([rows.column(o).to_numpy() for o in names], axis=1).view(np.uint64) for names in (SKETCH, PARITY))
        n = rows.column("n_shingles").to_numpy()
        second = rows.column("second").to_numpy()
        bands = pc.list_flatten(rows.column("bands")).to_numpy().reshape(-1, BANDS)
        here = rows.column("band")[0].as_py()
        across = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if across else (np.arange(len(ids)),) * 2
        out = []
        for k in left.tolist():
            apart = most_apart(n[right] + n[k])
            far = np.bitwise_count(parity[right] ^ parity[k]).sum(axis=1)
            good = (np.bitwise_count(odd[right] ^ odd[k]).sum(axis=1) <= limit) & ((apart >= len(limits)) | (far <= limits[np.minimum(apart, len(limits) - 1)])) & (comp[right] != comp[k]) & (100 * np.minimum(n[right], n[k]) >= PERCENT * np.maximum(n[right], n[k]))
            some = np.flatnonzero(good)
            if some.size:  # two sets that share several bands are a pair in the first of these
                same = bands[right[some]] == bands[k]
                good[some] = bands[k][same.argmax(axis=1)] == here
            if best_only and good.any():
                out.append((ids[k], ids[right[int(np.where(good, far.astype(np.int64), 1 << 30).argmin())]]))
            elif good.any():
                out += [(ids[k], ids[m]) for m in right[good].tolist() if across or m > k]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None

        def flush() -> pa.RecordBatch | None:
            found = one(pa.concat_tables(held))
            held.clear()
            return pa.record_batch([pa.array([min(p) for p in found], pa.binary()), pa.array([max(p) for p in found], pa.binary())], names=["a", "b"]) if found else None

        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("band", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and last != tuple(keys[lo]) and (out := flush()) is not None:
                    yield out
                held.append(t.slice(lo, hi - lo))
                last = tuple(keys[lo])
        if held and (out := flush()) is not None:
            yield out

    return tiles.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a binary, b binary")


def links(docs: DataFrame, signed: DataFrame, exact: bool = False) -> DataFrame:
    """(a, b): each set of a component of similar sets, but its least, with the least."""
    filled = signed.where("n_shingles > 0")
    nodes = filled.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), *(F.max(o).alias(o) for o in ["bands", *SKETCH, *PARITY]))
    banded = filled.select("set_id", F.explode("bands").alias("band")).distinct()
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("set_id").alias("pivot")).where("size > 1").drop("size")
    members = materialise(banded.join(shared, "band"), "members")
    light = materialise(nodes.join(members.select("set_id").distinct(), "set_id", "left_semi"), "sketches")
    full = materialise(_full_sets(docs, light.select("set_id", "doc_id")), "sets")

    found = _verify(members.where("set_id != pivot").select(F.least("set_id", "pivot").alias("a"), F.greatest("set_id", "pivot").alias("b")), light, full, exact)
    stars = components(found)
    for best_only in (True, False):
        named = members.select("set_id", "band").join(stars.select(F.col("a").alias("set_id"), F.col("b").alias("root")), "set_id", "left")
        named = named.select("set_id", "band", F.coalesce("root", "set_id").alias("comp"))
        parts = named.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
        split = parts.groupBy("band").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        split = split.select("band", F.col("top.comp").alias("main"), F.col("top.n").alias("n_in"), (F.col("size") - F.col("top.n")).alias("n_out"))
        still = materialise(named.join(split, "band").join(light.drop("doc_id"), "set_id"), "open")
        if still.isEmpty():
            break
        more = _verify(_tile_pairs(still, best_only, exact), light, full, exact)
        discard(still)
        if not more.isEmpty():
            stars = components(stars.union(more))
    discard(members, light, full)
    return stars


def _grouped(docs: DataFrame, exact: bool) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and whether it is the row that stays (of rows that share a doc_id, one text's)."""
    with small_batches(docs.sparkSession):
        signed = materialise(sign(docs), "signed")
        stars = links(docs, signed, exact)
    row = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    least = signed.where("n_shingles > 0").groupBy("set_id").agg(F.min(row).alias("least"))
    rooted = least.join(stars.select(F.col("a").alias("set_id"), F.col("b").alias("root")), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = rooted.select("set_id", "root").join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("set_id", "first")
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_id").join(named, "set_id", "left")
    filled = F.col("n_shingles") > 0
    component = F.when(filled, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), (~filled | (row == F.col("first"))).alias("stays"))


def near_groups(docs: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Words part at ASCII white space, A-Z lowered. Documents of at least PERCENT percent Jaccard similarity are linked;
    component_id is the least doc_id reachable over links, and that document is kept. A text of fewer than five words is one
    shingle; without words (or null) it is empty and linked with nothing. Rows that repeat count as one document; a
    null doc_id is greater than any other. A very long text is hashed whole by one task. Other columns don't matter; an
    empty table gives an empty result. ``exact``: no pair that shares a band is dropped by its sketches; all are verified.
    """
    out = _grouped(docs, exact)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, exact: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay by near_groups(), with their columns, whatever their names.

    Of rows that share the least doc_id of a group but not their texts, those of one text stay (the least by hash).
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    gone = _grouped(docs, exact).where(~F.col("stays")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(F.coalesce(F.col("row.text").cast("string").cast("binary"), F.lit(b""))) == F.col("t"))
    return rows.join(gone, same, "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))
