"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of byte trigrams within words, hashed to ``DIMS`` places and normalised. Each language
has several centroids, from spherical k-means over a bounded sample of labelled rows; the language of the centroid
with the greatest cosine is the prediction, and a text too far from every centroid is rejected. Document frequencies
come from all rows of the training part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

DIMS = 1 << 12
#: The sample that centroids are fitted on: about so many rows of each language, chosen by a hash of doc_id and text;
#: rows that repeat both count once.
SAMPLE_PER_LANGUAGE = 600
CENTROIDS, ROUNDS, RESTARTS = 4, 12, 5
#: Steps of length (trigrams at most), and the share of the cosine that all but one in a thousand sample rows of its step
#: exceed below which a text is rejected. Short texts vary most: half would reject some in a language that is known.
STEPS, REJECT_SHARES = (16, 64, 256, 1024, 1 << 62), (0.2, 0.2, 0.2, 0.5, 0.5)
#: A step with fewer sample rows takes in those of the nearest steps, the longer first.
LEAST_ROWS = 20
UNDETERMINED = "und"

#: Bytes that part words are all made a space: ASCII other than letters.
FOLD = np.array([c if c >= 128 or 97 <= c < 123 else 32 for c in range(256)], dtype=np.uint8)


def trigram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed trigrams of a whole text; None without a letter."""
    text = text.lower()
    if not any(map(str.isalpha, text)):
        return None
    b = FOLD[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)].astype(np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    code = code[(b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)


def sparse(counts: np.ndarray) -> bytes:
    """The places of trigrams that occur, 16 bits each, then their counts, 32 bits each."""
    place = np.flatnonzero(counts)
    return place.astype("<u2").tobytes() + counts[place].astype("<u4").tobytes()


def dense(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 6
    return np.frombuffer(data, "<u2", n).astype(np.int64), np.frombuffer(data, "<u4", n, 2 * n)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    """``centroids``: unit rows; ``labels``: a language for each; ``floor``: (most trigrams, least cosine) steps of rejection."""

    idf: np.ndarray
    centroids: np.ndarray
    labels: tuple[str, ...]
    floor: tuple[tuple[int, float], ...] = ()

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts.astype(np.float32)) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each whole text; the score is the greatest cosine, from 0 to 1."""
        out: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(texts)
        for at in range(0, len(texts), 256):
            some = [(i, c) for i, t in enumerate(texts[at : at + 256], at) if (c := trigram_counts(t or "")) is not None]
            if not some or not self.labels:
                continue
            counts = np.array([c for _, c in some])
            cosines = self.vectors(counts) @ self.centroids.T
            best, size = cosines.argmax(axis=1), counts.sum(axis=1)
            for (i, _), k, row, n in zip(some, best.tolist(), cosines, size.tolist(), strict=True):
                least = next((c for most, c in self.floor if n <= most), 0.0)
                out[i] = self.labels[k], float(min(1.0, max(0.0, row[k]))), bool(row[k] < least)
        return out


def cluster(rows: np.ndarray, k: int, rounds: int = ROUNDS, restarts: int = RESTARTS) -> np.ndarray:
    """Spherical k-means from k-means++ starts (random by squared distance); of ``restarts`` runs the one of greatest total cosine."""
    rng, best, most = np.random.default_rng(11), rows[:0], -np.inf
    for _ in range(restarts):
        starts = [int(rng.integers(len(rows)))]
        while len(starts) < min(k, len(rows)):
            apart = np.maximum(1 - (rows @ rows[starts].T).max(axis=1).astype(np.float64), 1e-12)  # half the squared distance
            apart[starts] = 0
            starts.append(int(rng.choice(len(rows), p=apart / apart.sum())))
        centres = rows[starts]
        for _ in range(rounds):
            of = (rows @ centres.T).argmax(axis=1)
            centres = unit(np.array([rows[of == c].mean(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))]))
        if (total := float((rows @ centres.T).max(axis=1).sum())) > most:
            best, most = centres, total
    return best


def floors(size: np.ndarray, cosine: np.ndarray) -> tuple[tuple[int, float], ...]:
    """``Model.floor`` from the sample rows' numbers of trigrams and greatest cosines; 0 throughout if there are fewer than LEAST_ROWS rows in all."""
    step = np.searchsorted(STEPS, size)
    out = []
    for i, (most, share) in enumerate(zip(STEPS, REJECT_SHARES, strict=True)):
        wider = sorted(range(len(STEPS)), key=lambda j: (abs(j - i), -j))
        here = next((h for n in range(1, len(STEPS) + 1) if len(h := cosine[np.isin(step, wider[:n])]) >= LEAST_ROWS), None)
        out.append((most, 0.0 if here is None else float(np.quantile(here, 0.001)) * share))
    return tuple(out)


def held_out() -> F.Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """A model of the rows of ``docs`` that aren't held out and have a language.

    Only counts, ``DIMS`` document frequencies and the sample's vectors (about ``per_language`` rows of each language,
    at most DIMS numbers each) come to the driver, however many rows there are.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    of_each = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {lang: min(1 << 30, -(-per_language * (1 << 30) // n)) for lang, n in of_each.items()}
    place = F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, most in sorted(share.items()):
        chosen = chosen | ((F.col("lang") == lang) & (place < most))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (c := trigram_counts(text or "")) is not None:
                    df += c > 0
                    n += 1
        if n:
            yield pa.record_batch([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[n], df]))], names=["dim", "n"])

    df = np.zeros(DIMS + 1, np.int64)
    for r in rows.select("text").mapInArrow(frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        df[r["dim"]] = r["n"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [(doc, lang, sparse(c)) for doc, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (c := trigram_counts(text or "")) is not None]
            return pa.record_batch([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["id", "lang", "counts"])

        return f


    def in_order(row: tuple[str, bytes]) -> tuple[str, bytes]:
        """By language and counts, place by place, so that clusters don't depend on how rows are dealt."""
        place, n = dense(row[1])
        every = np.zeros(DIMS, "<u2")
        every[place] = np.minimum(n, 65_535)
        return row[0], every.tobytes()

    # Sparse rows, and one dense matrix of 32-bit numbers: the driver is small.
    sample = sorted(((r["lang"], bytes(r["counts"])) for r in map_rows(rows.where(chosen).select(F.col("doc_id").cast("string"), "text", "lang"), make, "id string, lang string, counts binary").distinct().collect()), key=in_order)
    if not sample:
        return Model(idf, np.zeros((0, DIMS), np.float32), ())
    langs = [lang for lang, _ in sample]
    vectors, sizes = np.zeros((len(sample), DIMS), np.float32), np.zeros(len(sample), np.int64)
    for i, (_, data) in enumerate(sample):
        place, n = dense(data)
        row = np.log1p(n.astype(np.float32)) * idf[place]
        vectors[i, place], sizes[i] = unit(row), n.sum()
    del sample
    centres, labels = [], []
    for lang in sorted(set(langs)):
        own = vectors[[x == lang for x in langs]]
        got = cluster(own, centroids)
        centres.append(got)
        labels += [lang] * len(got)
    centres = np.concatenate(centres)
    return Model(idf, centres, tuple(labels), floors(sizes, (vectors @ centres.T).max(axis=1)))


PREDICTED = "lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row of ``docs`` (doc_id, text), from the text alone.

    A null text or one without a letter is ``und`` with score 0, and rejected; so is any if the model has learned no
    language. Of centroids at the same distance the first counts (languages in alphabetical order). A very long text is
    counted whole, into ``DIMS`` places. Rows that repeat are predicted each for itself. Other columns don't matter; an empty table gives an
    empty result.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = model.predict(batch.column(2).to_pylist())
            new = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            return pa.record_batch([batch.column(0), batch.column(1), *new], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")), make, f"doc_id long, held_out boolean, {PREDICTED}")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language isn't rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not r for _, _, r in model.predict(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
