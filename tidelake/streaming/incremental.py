"""Following a table: each micro-batch is one incremental read, from the last instant handled to the newest."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import EARLIEST, widen
from ..plans.config import COMMIT_TIME, ReadOptions
from ..sources.storage import Storage
from ..table import Table


class IncrementalFollower:
    """Hands new rows to ``sink(rows, batch number)`` and remembers the instants handled in ``checkpoint``, a folder of any store.

    A batch is handed over again if the sink succeeded but the checkpoint wasn't written, so sinks should be idempotent
    by batch number, as for foreachBatch.
    """

    def __init__(self, spark: SparkSession, uri: str, sink: Callable[[DataFrame, int], None], checkpoint: str, options: ReadOptions | None = None) -> None:
        self.spark, self.uri, self.sink, self.options = spark, uri, sink, options or ReadOptions()
        self.storage = Storage(spark, checkpoint)

    def _state(self) -> tuple[list[str], int]:
        """Instants handled (none before the first one of the active timeline), and the next batch's number."""
        if self.storage.exists("offset.json"):
            got = json.loads(self.storage.read("offset.json"))
            return got["handled"], got["batch"]
        return [], 0

    def run_once(self) -> bool:
        """One batch, if the table has new completed instants: also one requested before those handled but completed after them."""
        handled, batch = self._state()
        table = Table.open(self.spark, self.uri)
        done = {widen(t) for t in handled}
        instants = table.timeline.between(self.options.resolved(table.timezone).start or EARLIEST, None)
        new = [i.time for i in instants if widen(i.time) not in done]
        if not new:
            return False
        before = [i.time for i in instants if widen(i.time) < widen(new[0])]
        rows = table.read(replace(self.options, query_type="incremental", start=before[-1] if before else self.options.start, end=new[-1]))
        if table.config.has_meta_fields and COMMIT_TIME in rows.columns:
            rows = rows.where(F.rpad(COMMIT_TIME, 17, "0").isin([widen(t) for t in new]))
        self.sink(rows, batch)
        first = min(widen(i.time) for i in instants)
        state = {"handled": sorted({t for t in (*handled, *new) if widen(t) >= first}), "batch": batch + 1}
        self.storage.write(json.dumps(state).encode(), "offset.json")
        return True
