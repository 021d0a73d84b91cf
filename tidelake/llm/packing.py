"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits in one sequence. The program asks for the fewest
configurations that cover the length histogram. It is solved by multiplicative weights: a length's weight falls as
it is covered, and configurations of greatest weight are found by a knapsack dynamic program. The fractional solution
is rounded down, with all configurations, filled or not; what is left is priced again in whole numbers, and pieces of
poorly filled configurations go by best fit, longest first, into the open room or new sequences.

The histogram has at most ``capacity`` bins, so the driver's work and memory don't grow with the documents. The plan
goes back to the executors as a table of runs; each piece finds its place by its rank among the pieces of its length,
which comes from ranks within tasks and counts of tasks, so no length is gathered anywhere.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, materialise, piece_ids

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass(frozen=True)
class Run:
    """``count`` sequences alike, the first of which is number ``first``; ``items``: (length, how many), longest first."""

    first: int
    count: int
    items: tuple[tuple[int, int], ...]


class Pricing:
    """The knapsack dynamic program: configurations of greatest total weight, any number of each length.

    One run gives the best configuration of each room up to ``capacity``, and so the best one with any given length in it.
    """

    def __init__(self, weights: np.ndarray, lengths: np.ndarray, capacity: int) -> None:
        """``lengths`` ascend."""
        self.weights, self.lengths, self.capacity = weights, lengths, capacity
        # A length that weighs no more than a shorter one is never needed.
        own = np.flatnonzero(weights > np.maximum.accumulate(np.concatenate([[0.0], weights[:-1]])))
        short, weight = lengths[own], weights[own]
        self.value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room, k in enumerate(np.searchsorted(short, np.arange(capacity + 1), side="right").tolist()):
            if k:
                got = weight[:k] + self.value[room - short[:k]]
                i = int(got.argmax())
                choice[room], self.value[room] = own[i], got[i]
        self.choice = choice.tolist()

    @property
    def best(self) -> float:
        return float(self.value[self.capacity])

    def seeds(self, tolerance: float) -> list[int]:
        """The lengths (by number) whose best configuration weighs at least ``1 - tolerance`` times the best of all, heaviest first."""
        with_it = self.weights + self.value[self.capacity - self.lengths]
        order = np.argsort(-with_it, kind="stable")
        return order[with_it[order] >= (1 - tolerance) * self.best].tolist()

    def configuration(self, seed: int) -> Counter:
        """The best configuration with this length in it."""
        out, room = Counter([seed]), self.capacity - int(self.lengths[seed])
        while room > 0 and (i := self.choice[room]) >= 0:
            out[i] += 1
            room -= int(self.lengths[i])
        return out


#: What share of a length's demand one round covers at most; how fast weights fall as lengths are covered; how much less
#: than the best a configuration may weigh to be used; and the power of the length that weights begin with (more than 1:
#: long pieces, which are the hardest to place, go first).
STEP, SHARPNESS, TOLERANCE, POWER = 0.1, 10.0, 0.01, 1.2


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, whole: bool = False, step: float = STEP) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """Configurations (length's number, how many) and how many of each, covering every demand; and a lower bound of the program.

    Multiplicative weights: a length's weight falls exponentially in the share of its demand that is covered. The
    knapsack program prices configurations; those near the best are used until one of their lengths is covered by
    another ``step``, and a covered length leaves, so there are at most len(lengths) / step rounds. Weights divided by
    the best configuration's are a feasible dual solution, so each round gives a lower bound. ``whole``: use only whole
    numbers of configurations and cover no demand beyond itself, which makes the solution a packing.
    """
    covered, found, bound = np.zeros(len(lengths)), {}, 0.0
    first = (lengths / capacity) ** POWER
    demand = demand.astype(np.float64)
    if len(lengths):
        bound = float((demand * lengths).sum()) / capacity  # the dual solution of weights as lengths
    while (left := np.flatnonzero(covered < 1)).size:
        share = covered[left]
        weights = first[left] * np.exp(-SHARPNESS * (share - share.min()))
        pricing = Pricing(weights, lengths[left], capacity)
        bound = max(bound, float((demand[left] * weights).sum()) / pricing.best)
        limit = np.minimum(1.0, covered + step)
        for seed in pricing.seeds(TOLERANCE):
            if covered[left[seed]] >= limit[left[seed]]:
                continue
            config = pricing.configuration(seed)
            if whole:
                rest = {int(left[i]): round(demand[left[i]] * (1 - covered[left[i]])) for i in config}
                items = [(int(left[i]), min(n, rest[int(left[i])])) for i, n in config.items() if rest[int(left[i])]]
                size = min(max(1, math.floor((limit[i] - covered[i]) * demand[i] / n)) for i, n in items)
                size = min([size, *(rest[i] // n for i, n in items)])
            else:
                items = [(int(left[i]), min(n, int(demand[left[i]]))) for i, n in config.items()]
                size = min((limit[i] - covered[i]) * demand[i] / n for i, n in items)
            if size <= 1e-9:
                continue
            for i, n in items:
                covered[i] += size * n / demand[i]
                if covered[i] > 1 - 1e-7:
                    covered[i] = 1.0
            key = tuple(sorted(items))
            found[key] = found.get(key, 0) + size
    return found, bound


#: Steps are halved while a solution is more than ``GAP`` above its bound, for about so many rounds of pricing in all.
GAP, MOST_ROUNDS = 0.002, 2000


def refined(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """The best solution of several steps, and the best bound."""
    best, bound, rounds, step = None, 0.0, 0, STEP
    while best is None or (sum(best.values()) > (1 + GAP) * bound and 2 * rounds <= MOST_ROUNDS and step > 0.01):
        found, least = solve(lengths, demand, capacity, step=step)
        bound, rounds, step = max(bound, least), rounds + math.ceil(len(lengths) / step / 10), step / 2
        if best is None or sum(found.values()) < sum(best.values()):
            best = found
    return best, bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs that hold each piece of ``histogram`` (length to count) exactly once; a sequence never exceeds ``capacity``.

    The program's solution is rounded down. What is left is priced again in whole configurations; of these the poorly
    filled ones are taken apart, and their pieces go by best fit into all open room. How poorly filled, is decided by
    the fewest sequences; best fit of everything is tried too, as it may win where lengths are few and alike.
    """
    histogram = {int(k): int(n) for k, n in histogram.items() if n > 0}
    if bad := [k for k in histogram if not 0 < k <= capacity]:
        raise ValueError(f"lengths beyond 1 to {capacity}: {bad[:3]}")
    left, shapes = Counter(histogram), Counter()
    if full := left.pop(capacity, 0):
        shapes[((capacity, 1),)] = full

    def spelled(configs: dict[tuple[tuple[int, int], ...], float], lengths: np.ndarray) -> Counter:
        return Counter({tuple(sorted(((int(lengths[i]), n) for i, n in c), reverse=True)): math.floor(x + 1e-9) for c, x in configs.items()})

    if left:
        lengths = np.array(sorted(left))
        configs = refined(lengths, np.array([left[int(k)] for k in lengths]), capacity)[0]
        for shape, x in sorted(spelled(configs, lengths).items(), key=lambda p: (-p[1], p[0])):
            if count := min([x, *(left[k] // n for k, n in shape)]):  # rounding may cover a length a little beyond its demand
                shapes[shape] += count
                for k, n in shape:
                    left[k] -= n * count
        left = +left
        lengths = np.array(sorted(left), dtype=np.int64)
        again = +spelled(solve(lengths, np.array([left[int(k)] for k in lengths]), capacity, whole=True)[0], lengths)
        fill = lambda shape: sum(k * n for k, n in shape) / capacity
        tries = [+best_fit(Counter(histogram), Counter(), capacity)]
        for least in (0.0, 0.9, 0.97, 0.99, 1.1):
            kept, loose = Counter(shapes), Counter()
            for shape, count in again.items():
                if fill(shape) >= least:
                    kept[shape] += count
                else:
                    loose.update({k: n * count for k, n in shape})
            for shape, count in best_fit(loose, Counter({s: n for s, n in kept.items() if fill(s) < 1}), capacity).items():
                kept[shape] += count
            tries.append(+kept)
        shapes = min(tries, key=Counter.total)
    runs, first = [], 0
    for shape, count in sorted(shapes.items(), reverse=True):
        runs.append(Run(first, count, shape))
        first += count
    return runs


def best_fit(left: Counter, open_shapes: Counter, capacity: int) -> Counter:
    """How the number of sequences of each shape changes as the pieces ``left`` go, longest first, to the fullest sequences with room.

    It works on shapes with their counts, never on single sequences.
    """
    delta: Counter = Counter()
    by_room: dict[int, Counter] = {}
    for shape, n in open_shapes.items():
        by_room.setdefault(capacity - sum(k * m for k, m in shape), Counter())[shape] += n
    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            room = min((r for r, s in by_room.items() if r >= length and s), default=None)
            fits = capacity // length if room is None else room // length
            if room is None:
                shape, count = (), max(1, todo // fits)
            else:
                shape, have = next(iter(by_room[room].items()))
                count = min(have, max(1, todo // fits))
                by_room[room][shape] -= count
                by_room[room] = +by_room[room]
                delta[shape] -= count
            put = min(fits, todo // count) if count > 1 else min(fits, todo)
            new = Counter(dict(shape))
            new[length] += put
            grown = tuple(sorted(new.items(), reverse=True))
            delta[grown] += count
            by_room.setdefault(capacity - sum(k * m for k, m in grown), Counter())[grown] += count
            todo -= put * count
    return delta


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, with each one's rank among those of its length in its task."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        ids, seen, task = piece_ids(tokenizer_path), Counter(), TaskContext.get().partitionId()
        end = int(end_id).to_bytes(4, "little")

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = ids.encode(text or "") + end
                n = len(data) // 4
                head = (n - 1) % capacity + 1 if n > capacity else n
                start = 0
                for piece, stop in enumerate(range(head, n + 1, capacity)):
                    size = stop - start
                    rows.append((doc, piece, start, size, zlib.crc32(data[4 * start : 4 * stop]), task, seen[size]))
                    seen[size] += 1
                    start = stop
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        return f

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text; other columns don't matter) with the sequence and offset it is placed at.

    A text is tokenized whole and ``end_id`` appended. A document of more than ``capacity`` ids is cut into pieces of
    ``capacity``, the first of which may be shorter; any other is one piece. A null or empty text is the end id alone.
    Rows that repeat are packed each for itself, doc_id may be null, and an empty table gives an empty result.
    The pieces (not the texts) are kept in the shared folder between the two passes.
    """
    pieces = materialise(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = pieces.groupBy("task", "length").count()
    runs = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    by_task = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("count").over(by_task), F.lit(0)).alias("before"))

    place: dict[int, list[tuple[int, int, int, int]]] = {}  # length: (first rank, a sequence's, first sequence, offset)
    taken: Counter = Counter()
    for run in runs:
        offset = 0
        for length, n in run.items:
            place.setdefault(length, []).append((taken[length], n, run.first, offset))
            taken[length] += n * run.count
            offset += n * length
    tables = {k: np.array(v, dtype=np.int64).T for k, v in place.items()}

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                base, each, first, off = tables[int(length[at[0]])]
                i = np.searchsorted(base, rank[at], side="right") - 1
                copy, j = np.divmod(rank[at] - base[i], each[i])
                sequence[at], offset[at] = first[i] + copy, off[i] + j * length[at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            return pa.record_batch([*(batch.column(k) for k in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

        return f

    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return map_rows(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), make, PLACED)
