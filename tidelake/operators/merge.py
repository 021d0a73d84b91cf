"""Merge on read as DataFrame operations: a slice's base rows and what its log files say, deletions included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..plans.config import APPEND_ONLY, COMMIT_SEQNO, COMMIT_TIME, RECORD_KEY

#: Columns beside a table's own: a row's file slice, and whether it is a deletion (key, ordering value and time only).
SLICE, DEAD = "__slice", "__dead"


def append_only(rows: DataFrame) -> DataFrame:
    """All rows; deletions don't count."""
    return rows.where(~F.col(DEAD))


def latest_wins(rows: DataFrame, ordering: str) -> DataFrame:
    """Per slice and record key the row greatest by (ordering, sequence number), unless a deletion outranks it.

    Of a key's deletions the greatest ordering and the greatest commit time count, each for itself. A greatest ordering
    of 0 means that commit times decide; else the ordering does, and commit times on a tie. A null ordering is the
    least. One exchange and one sort serve rows and deletions; only slices with log files come here.
    """
    key = Window.partitionBy(SLICE, RECORD_KEY)
    best = key.orderBy(F.col(DEAD), F.col(ordering).desc_nulls_last(), F.col(COMMIT_SEQNO).desc_nulls_last())
    time = F.rpad(COMMIT_TIME, 17, "0")
    o, t = F.col("__o"), F.col("__t")
    rows = rows.select("*", F.row_number().over(best).alias("__rank"), F.max(F.when(F.col(DEAD), F.col(ordering))).over(key).alias("__o"), F.max(F.when(F.col(DEAD), time)).over(key).alias("__t"))
    zero = o == 0 if isinstance(rows.schema[ordering].dataType, NumericType) else F.lit(False)
    outranked = F.when(zero, t > time).otherwise(F.coalesce(o > F.col(ordering), o.isNotNull()) | (o.eqNullSafe(F.col(ordering)) & (t > time)))
    return rows.where((F.col("__rank") == 1) & ~F.col(DEAD) & (t.isNull() | ~F.coalesce(outranked, F.lit(False)))).drop("__rank", "__o", "__t")


def merge(strategy: str, rows: DataFrame, ordering: str | None) -> DataFrame:
    if strategy == APPEND_ONLY or ordering is None:
        return append_only(rows)
    return latest_wins(rows, ordering)
