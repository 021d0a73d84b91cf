"""Tables made from the star schema, for the queries on tables."""

from __future__ import annotations

import json
import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import META_FIELDS, META_FOLDER, TIMELINE_FOLDER
from ..sources.storage import shared_folder
from ..sources.writer import TableWriter

C0, C1, C2, C3, C4 = (f"202401{d:02d}000000000" for d in (1, 2, 3, 4, 5))
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "ts"]
AVRO = {"o_orderkey": "long", "o_custkey": "long", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string", "ts": "long"}
SCHEMA = json.dumps({"type": "record", "name": "orders", "fields": [{"name": c, "type": ["null", AVRO[c]]} for c in ORDERS]})


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidelake-table-{uuid.uuid4().hex}"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*ORDERS[:-1], F.lit(1).cast("long").alias("ts"))


def priorities(df: DataFrame) -> list[str]:
    return sorted(r[0] for r in df.select("o_orderpriority").distinct().collect())


def file_id(partition: str, n: int = 0) -> str:
    return f"{uuid.uuid5(uuid.NAMESPACE_OID, partition)}-{n}"


def orders_mor(spark: SparkSession, sf_dir: str, metadata: bool = False) -> str:
    """Inserts at C1; at C2 every key that ends in 3 doubles its price and every key that ends in 7 is deleted.

    ``metadata``: with a metadata table; it doesn't know the log file of the first priority."""
    path, df = folder(spark), orders(spark, sf_dir)
    more = {"table__metadata__partitions": "files"} if metadata else {}
    w = TableWriter(spark, path, SCHEMA, **more, table__name="orders", table__type="MERGE_ON_READ", table__version="8", table__recordkey__fields="o_orderkey", table__ordering__fields="ts", table__partition__fields="o_orderpriority", datasource__write__hive_style_partitioning="true")
    parts = priorities(df)
    for p in parts:
        w.base(df.where(F.col("o_orderpriority") == p), f"o_orderpriority={p}", file_id(p), C1)
    w.commit(C1, "deltacommit")
    for p in parts:
        own = df.where(F.col("o_orderpriority") == p)
        changed = own.where("o_orderkey % 10 = 3").withColumns({"o_totalprice": F.col("o_totalprice") * 2, "ts": F.lit(2).cast("long")})
        rows = w.meta(changed, f"o_orderpriority={p}", "", C2).select(*META_FIELDS, *ORDERS).toArrow()
        gone = [(str(r[0]), 2) for r in own.where("o_orderkey % 10 = 7").select("o_orderkey").collect()]
        w.log(f"o_orderpriority={p}", file_id(p), C2, [w.data_block(rows, C2), w.delete_block(gone, C2)])
    w.commit(C2, "deltacommit")
    if metadata:
        folders = {f"o_orderpriority={p}": w.storage.listing(f"o_orderpriority={p}")[0] for p in parts}
        w.metadata_table({d: {f.name: (f.size, False) for f in files if not f.name.startswith(".") or d != f"o_orderpriority={parts[0]}"} for d, files in folders.items()}, C2)
    return path


def orders_cow(spark: SparkSession, sf_dir: str) -> str:
    """Inserts at C1; at C2 the first priority is overwritten by its orders above 100,000."""
    path, df = folder(spark), orders(spark, sf_dir)
    w = TableWriter(spark, path, SCHEMA, table__name="orders", table__type="COPY_ON_WRITE", table__version="6", table__recordkey__fields="o_orderkey", table__precombine__field="ts", table__partition__fields="o_orderpriority", datasource__write__hive_style_partitioning="true")
    parts = priorities(df)
    for p in parts:
        w.base(df.where(F.col("o_orderpriority") == p), f"o_orderpriority={p}", file_id(p), C1)
    w.commit(C1)
    first = f"o_orderpriority={parts[0]}"
    w.base(df.where((F.col("o_orderpriority") == parts[0]) & (F.col("o_totalprice") > 100000)), first, file_id(parts[0], 1), C2)
    w.commit(C2, "replacecommit", replaced={first: [file_id(parts[0])]}, operation="insert_overwrite")
    return path


def orders_archived(spark: SparkSession, sf_dir: str, version: str) -> str:
    """Inserts at C1, at C2 the first priority's orders above 100,000 anew in a second file; C1 is archived.

    Files of C3 (under way, in no timeline) and of a failed instant before C1 (requested only) must not count.
    """
    path, df = folder(spark), orders(spark, sf_dir)
    w = TableWriter(spark, path, SCHEMA, table__name="orders", table__type="COPY_ON_WRITE", table__version=version, table__recordkey__fields="o_orderkey", table__ordering__fields="ts", table__partition__fields="o_orderpriority", datasource__write__hive_style_partitioning="true")
    parts = priorities(df)
    of = lambda p: df.where(F.col("o_orderpriority") == p)
    for p in parts:
        w.base(of(p), f"o_orderpriority={p}", file_id(p), C1)
    w.commit(C1)
    w.base(of(parts[0]).where("o_totalprice > 100000"), f"o_orderpriority={parts[0]}", file_id(parts[0], 1), C2)
    w.commit(C2)
    for n, time in ((2, C0), (3, C3)):
        w.base(of(parts[1]), f"o_orderpriority={parts[1]}", file_id(parts[1], n), time)
    w.stats = {}
    w.storage.write(b"", TIMELINE_FOLDER if w.layout == 2 else META_FOLDER, f"{C0}.commit.requested")
    w.archive(C1)
    return path


def orders_logs(spark: SparkSession, sf_dir: str) -> str:
    """One file of all orders at C1, ordering value 5; then logs of every sort, by the last digit of the key.

    C2, Avro: 1 gets twice its price at ordering 6, 2 thrice at ordering 4 (too late). Deletes by ordering 0 (3), 6 (4),
    4 (5: outranked) and none (6). C3, Parquet: 8 costs nothing, rolled back. C4, Parquet: 9 gets ten times its price.
    """
    path, df = folder(spark), orders(spark, sf_dir).withColumn("ts", F.lit(5).cast("long"))
    w = TableWriter(spark, path, SCHEMA, table__name="orders", table__type="MERGE_ON_READ", table__version="6", table__recordkey__fields="o_orderkey", table__precombine__field="ts")
    w.base(df, "", file_id("", 0), C1)
    w.commit(C1, "deltacommit")
    digit = F.col("o_orderkey") % 10

    def changed(d: int, factor: float, ts: int, time: str) -> DataFrame:
        rows = df.where(digit == d).withColumns({"o_totalprice": F.col("o_totalprice") * factor, "ts": F.lit(ts).cast("long")})
        return w.meta(rows, "", "", time).select(*META_FIELDS, *ORDERS)

    def gone(rows: pa.Table) -> bytes:
        return TableWriter.delete_block(list(zip(*(c.to_pylist() for c in rows.columns), strict=True)), C2)

    deleted = df.where(digit.between(3, 6)).select(F.col("o_orderkey").cast("string"), F.when(digit == 3, 0).when(digit == 4, 6).when(digit == 5, 4).cast("long"))
    n = w.logs("", file_id("", 0), C1, changed(1, 2.0, 6, C2).union(changed(2, 3.0, 4, C2)), partial(TableWriter.avro_block, instant=C2))
    n = w.logs("", file_id("", 0), C1, deleted, gone, version=n)
    w.commit(C2, "deltacommit")
    n = w.logs("", file_id("", 0), C1, changed(8, 0.0, 9, C3), partial(TableWriter.data_block, instant=C3), version=n)
    w.log("", file_id("", 0), C1, [w.rollback_block(C3, C4)], version=n)
    w.logs("", file_id("", 0), C1, changed(9, 10.0, 7, C4), partial(TableWriter.data_block, instant=C4), version=n + 1)
    w.commit(C4, "deltacommit")
    return path


def orders_by_price(spark: SparkSession, sf_dir: str) -> str:
    """Copy on write, not partitioned: a file for each 100,000 of price."""
    path, df = folder(spark), orders(spark, sf_dir)
    w = TableWriter(spark, path, SCHEMA, table__name="orders", table__type="COPY_ON_WRITE", table__version="6", table__recordkey__fields="o_orderkey", table__precombine__field="ts")
    step = F.floor(F.col("o_totalprice") / 100000)
    for n in sorted(r[0] for r in df.select(step.alias("n")).distinct().collect()):
        w.base(df.where(step == n), "", file_id("", n), C1)
    w.commit(C1)
    return path


def orders_by_month(spark: SparkSession, sf_dir: str) -> str:
    """Partitioned by the timestamp key generator: seconds since 1970 of the order's date to yyyy/MM."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("secs"))
    schema = json.dumps({"type": "record", "name": "orders", "fields": [{"name": c, "type": ["null", "long"]} for c in ("o_orderkey", "secs")]})
    path, month = folder(spark), F.date_format(F.timestamp_seconds("secs"), "yyyy/MM")
    w = TableWriter(spark, path, schema, table__name="orders", table__type="COPY_ON_WRITE", table__version="6", table__recordkey__fields="o_orderkey", table__precombine__field="secs", table__partition__fields="secs", table__keygenerator__class="TimestampBasedKeyGenerator", keygen__timebased__timestamp__type="UNIX_TIMESTAMP", keygen__timebased__output__dateformat="yyyy/MM")
    first = sorted(r[0] for r in df.select(month.alias("m")).distinct().collect())[:8]
    for m in first:
        w.base(df.where(month == m), m, file_id(m), C1)
    w.commit(C1)
    return path
