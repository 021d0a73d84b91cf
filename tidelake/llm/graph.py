"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node's neighbours (large: the greater ones, else the lesser ones and itself) get the least neighbour.

    A hub's neighbours are dealt by (node, salt), and each of its salts learns the least neighbour: no task gets all of them.
    """
    around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    salts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = around.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
    least = around.groupBy("a", "salt").agg(F.min("b").alias("b"))
    least = least.select("a", "salt", F.least("a", F.min("b").over(Window.partitionBy("a"))).alias("m"))  # of a node, a row for each salt
    joined = around.join(least, ["a", "salt"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (a, b): each node but the least of its component with that least node.

    Large-star and small-star rounds in turn; each is written to the shared folder, where the one before is deleted, and
    no edge comes to the driver. A star in a star's plan would be there once for each time that it is read, and the
    driver holds and compiles all of that.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    seen = None
    while True:
        for large in (True, False):
            new = materialise(_star(now, large), "edges")
            discard(now)
            now = new
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now
        seen = mark
