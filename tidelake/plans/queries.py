"""Queries for the driver: relational SQL over the star schema, and reads of tables made from it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import col
from ..plans.config import ReadOptions
from ..sources.datasource import create_table, register
from ..table import Table
from .fixtures import C0, C1, C2, ORDERS, orders_archived, orders_by_month, orders_by_price, orders_cow, orders_logs, orders_mor

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: One text for both engines. Sums of doubles are rounded, as their last digits depend on the order of addition.
SQL = {
    "q1_pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty,
               round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= date '1998-12-01' - interval '68' day
        GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "q2_least_by_group": """
        SELECT s_acctbal, s_name, n_name, p_partkey, l_extendedprice FROM part, supplier, lineitem, nation, region
        WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_size < 10 AND p_type LIKE '%O%' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 2
          AND l_extendedprice = (SELECT min(inside.l_extendedprice) FROM lineitem AS inside, supplier AS own, nation AS near
            WHERE p_partkey = inside.l_partkey AND own.s_suppkey = inside.l_suppkey AND own.s_nationkey = near.n_nationkey AND near.n_regionkey = 2)
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey, l_extendedprice LIMIT 100""",
    "q3_top_orders": """
        SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
        FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q4_semi_join": """
        SELECT o_orderpriority, count(*) AS order_count FROM orders
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q5_local_supplier": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
          AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
        GROUP BY n_name ORDER BY revenue DESC""",
    "q6_forecast": """
        SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
        WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24""",
    "q7_volume_shipping": """
        SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
          SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, extract(year FROM l_shipdate) AS l_year, l_extendedprice * (1 - l_discount) AS volume
          FROM supplier, lineitem, orders, customer, nation n1, nation n2
          WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
            AND ((n1.n_nationkey = 1 AND n2.n_nationkey = 2) OR (n1.n_nationkey = 2 AND n2.n_nationkey = 1))) AS shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "q8_market_share": """
        SELECT o_year, round(sum(CASE WHEN nation_key = 2 THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
          SELECT extract(year FROM o_orderdate) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_nationkey AS nation_key
          FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
          WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey
            AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_regionkey = 1 AND s_nationkey = n2.n_nationkey) AS all_nations
        GROUP BY o_year ORDER BY o_year""",
    "q9_profit_by_year": """
        SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
          SELECT n_name AS nation, extract(year FROM o_orderdate) AS o_year, l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity AS amount
          FROM part, supplier, lineitem, orders, nation
          WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%co%') AS profit
        GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "q10_returned_items": """
        SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name
        FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11_scalar_having": """
        SELECT l_partkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_partkey
        HAVING sum(l_quantity) > (SELECT sum(l_quantity) * 0.0008 FROM lineitem) ORDER BY qty DESC, l_partkey""",
    "q12_case_counts": """
        SELECT o_orderstatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high_count,
               sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderstatus ORDER BY o_orderstatus""",
    "q13_two_level": """
        SELECT c_count, count(*) AS custdist FROM (
          SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%'
          GROUP BY c_custkey) AS c_orders
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "q14_promo_share": """
        SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
        FROM lineitem, part WHERE l_partkey = p_partkey""",
    "q15_top_supplier": """
        WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total FROM supplier, revenue WHERE s_suppkey = supplier_no AND total = (SELECT max(total) FROM revenue) ORDER BY s_suppkey""",
    "q16_distinct_not_in": """
        SELECT p_brand, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part
        WHERE p_partkey = l_partkey AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
        GROUP BY p_brand, p_size ORDER BY supplier_cnt DESC, p_brand, p_size""",
    "q17_correlated": """
        SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part
        WHERE p_partkey = l_partkey AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem AS inside WHERE inside.l_partkey = p_partkey)""",
    "q18_large_orders": """
        SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "q19_or_of_ands": """
        SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part
        WHERE (p_partkey = l_partkey AND p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11)
           OR (p_partkey = l_partkey AND p_size BETWEEN 6 AND 15 AND l_quantity BETWEEN 10 AND 30)""",
    "q20_nested_in": """
        SELECT s_name, s_acctbal FROM supplier, nation
        WHERE s_nationkey = n_nationkey AND n_nationkey < 12 AND s_suppkey IN (
          SELECT l1.l_suppkey FROM lineitem l1 WHERE l1.l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'co%')
            AND l1.l_quantity > (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = l1.l_partkey AND l2.l_shipdate >= timestamp '1995-01-01 00:00:00'))
        ORDER BY s_name""",
    "q21_semi_anti_residual": """
        SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1
        WHERE s_suppkey = l1.l_suppkey AND l1.l_returnflag = 'R'
          AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'A')
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22_anti_substring": """
        SELECT code, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
          SELECT substring(c_name FROM 1 FOR 10) AS code, c_acctbal FROM customer
          WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)) AS custsale
        GROUP BY code ORDER BY code""",
}


def sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in text:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(text)

    return run


PLAIN = ORDERS[:-1]


def table_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, orders_mor(spark, sf_dir)).read(ReadOptions().with_projection(*PLAIN))


def table_metadata_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the metadata table, which leaves out the first priority's log file."""
    return Table.open(spark, orders_mor(spark, sf_dir, metadata=True)).read(ReadOptions().with_projection(*PLAIN))


def table_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition's rows; the others' files aren't planned."""
    return Table.open(spark, orders_mor(spark, sf_dir)).read(ReadOptions().with_filters(col("o_orderpriority").eq("1-URGENT")).with_projection(*PLAIN))


def table_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and log rows side by side, without a merge."""
    t = Table.open(spark, orders_mor(spark, sf_dir), {"hoodie.table.record.merge.strategy": "APPEND_ONLY"})
    return t.read(ReadOptions().with_projection(*PLAIN))


def table_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    instants = Table.open(spark, orders_cow(spark, sf_dir)).timeline.commits(newest_first=True)
    return spark.createDataFrame([(i.time, i.action) for i in instants], "instant string, action string")


def table_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, orders_mor(spark, sf_dir)).read(ReadOptions().with_as_of(C1).with_projection(*PLAIN))


def table_read_optimized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, orders_mor(spark, sf_dir)).read(ReadOptions().with_read_optimized().with_projection(*PLAIN))


def table_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ReadOptions().with_query_type("incremental").with_start(C1).with_end(C2)
    return Table.open(spark, orders_mor(spark, sf_dir)).read(options.with_projection(*PLAIN))


def table_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = ReadOptions().with_filters(("o_orderpriority", "IN", "1-URGENT,2-HIGH"), col("o_totalprice").gte(150000), ("o_orderstatus", "!=", "F"))
    return Table.open(spark, orders_mor(spark, sf_dir)).read(options.with_projection("o_orderkey", "o_totalprice"))


def table_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, orders_cow(spark, sf_dir)).read(ReadOptions().with_projection(*PLAIN))


def table_before_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table.open(spark, orders_cow(spark, sf_dir)).read(ReadOptions().with_as_of("2024-01-02T12:00:00Z").with_projection(*PLAIN))


def table_sql_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    Table.open(spark, orders_mor(spark, sf_dir)).create_view("orders_table")
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders_table JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")


def table_file_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = Table.open(spark, orders_mor(spark, sf_dir)).file_slices()
    return spark.createDataFrame([(s.partition, len(s.logs)) for s in slices], "partition string, n_logs long")


def table_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both timeline layouts, the oldest instant archived: its files still count."""
    one, two = (Table.open(spark, orders_archived(spark, sf_dir, v)).read(ReadOptions().with_projection(*PLAIN)).withColumn("layout", F.lit(n)) for n, v in ((1, "6"), (2, "8")))
    return one.union(two)


def table_archived_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived and active instants of both layouts, and the rows of an incremental read that reaches into the archive."""
    out = None
    for n, v in ((1, "6"), (2, "8")):
        t = Table.open(spark, orders_archived(spark, sf_dir, v), {"hoodie.internal.timeline.archived.enabled": "true"})
        rows = t.read(ReadOptions().with_query_type("incremental").with_start(C0).with_end(C1)).groupBy().count().select(F.lit(n).alias("layout"), F.lit(",".join(i.time for i in t.timeline.commits())).alias("instants"), F.col("count").alias("n"))
        out = rows if out is None else out.union(rows)
    return out


def table_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Avro and Parquet blocks, tombstones by ordering and by commit time, and a rollback."""
    return Table.open(spark, orders_logs(spark, sf_dir)).read(ReadOptions().with_projection(*PLAIN))


def table_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_logs(spark, sf_dir).where("o_orderkey % 10 BETWEEN 3 AND 6")


def table_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came after C2: the rolled-back block's rows aren't there."""
    options = ReadOptions().with_query_type("incremental").with_start(C2)
    return Table.open(spark, orders_logs(spark, sf_dir)).read(options.with_projection(*PLAIN))


def table_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file slice alone, filtered and projected."""
    t = Table.open(spark, orders_logs(spark, sf_dir))
    return t.read_file_slice(t.file_slices()[0], ReadOptions().with_filters(col("o_totalprice").gt(400000)).with_projection("o_orderkey", "o_totalprice"))


def table_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By SQL on a catalog table of the registered source; the predicate on the partition reaches planning."""
    name = f"orders_{uuid.uuid4().hex}"
    create_table(spark, name, orders_mor(spark, sf_dir))
    return spark.sql(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM {name} WHERE o_orderpriority = '2-HIGH' AND o_totalprice BETWEEN 1000 AND 300000")


def table_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered source over logs of every sort: it merges slice by slice."""
    register(spark)
    return spark.read.format("tidelake").load(orders_logs(spark, sf_dir)).select(*PLAIN)


def table_file_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base files are left after the footers, and the rows."""
    t, options = Table.open(spark, orders_by_price(spark, sf_dir)), ReadOptions().with_filters(col("o_totalprice").lt(150000))
    return t.read(options.with_projection("o_orderkey", "o_totalprice")).withColumn("n_files", F.lit(len(t.file_slices(options))).cast("long"))


def table_keygen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions by a timestamp key generator, pruned by filters on its source column."""
    t = Table.open(spark, orders_by_month(spark, sf_dir))
    cut = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.min("o_orderdate").cast("timestamp").alias("d")).select(F.unix_timestamp("d") + 40 * 86400).first()[0]
    options = ReadOptions().with_filters(col("secs").lte(cut))
    return t.read(options.with_projection("o_orderkey", "secs")).withColumn("n_partitions", F.lit(len({s.partition for s in t.file_slices(options)})).cast("long"))


def table_meta_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts without any column, and by a column of the format's own."""
    t = Table.open(spark, orders_mor(spark, sf_dir)).read()
    return t.groupBy(F.col("_hoodie_commit_time").alias("instant")).agg(F.count(F.lit(1)).alias("n")).unionByName(t.groupBy().count().select(F.lit("all").alias("instant"), F.col("count").alias("n")))


NOW = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 7"
ALL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
ARCHIVED = f"{ALL} UNION ALL {ALL} WHERE o_totalprice > 100000 AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders)"
LOGGED = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * CASE o_orderkey % 10 WHEN 1 THEN 2 WHEN 9 THEN 10 ELSE 1 END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 10 NOT IN (3, 4)"
MONTHS = "WITH o AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS secs, strftime(o_orderdate, '%Y/%m') AS month FROM orders), m AS (SELECT DISTINCT month FROM o ORDER BY month LIMIT 8), c AS (SELECT min(secs) + 40 * 86400 AS cut FROM o)"
TABLE_QUERIES = {
    table_snapshot: NOW,
    table_metadata_listing: f"{ALL} WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) UNION ALL SELECT * FROM ({NOW}) AS t WHERE o_orderpriority > (SELECT min(o_orderpriority) FROM orders)",
    table_pruned: f"SELECT * FROM ({NOW}) AS t WHERE o_orderpriority = '1-URGENT'",
    table_append_only: f"{ALL} UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 2, o_orderpriority FROM orders WHERE o_orderkey % 10 = 3",
    table_timeline: f"SELECT '{C1}' AS instant, 'commit' AS action UNION ALL SELECT '{C2}', 'replacecommit'",
    table_time_travel: ALL,
    table_read_optimized: ALL,
    table_incremental: f"SELECT * FROM ({NOW}) AS t WHERE o_orderkey % 10 = 3",
    table_filtered: f"SELECT o_orderkey, o_totalprice FROM ({NOW}) AS t WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 150000 AND o_orderstatus <> 'F'",
    table_overwritten: f"{ALL} WHERE o_orderpriority > (SELECT min(o_orderpriority) FROM orders) OR o_totalprice > 100000",
    table_before_overwrite: ALL,
    table_sql_join: f"SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM ({NOW}) AS t JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    table_archived: f"SELECT *, 1 AS layout FROM ({ARCHIVED}) AS a UNION ALL SELECT *, 2 FROM ({ARCHIVED}) AS b",
    table_archived_timeline: f"SELECT layout, '{C1},{C2}' AS instants, (SELECT count(*) FROM orders) AS n FROM (VALUES (1), (2)) AS t(layout)",
    table_logs: LOGGED,
    table_tombstones: f"SELECT * FROM ({LOGGED}) AS t WHERE o_orderkey % 10 BETWEEN 3 AND 6",
    table_rollback: f"SELECT * FROM ({LOGGED}) AS t WHERE o_orderkey % 10 = 9",
    table_slice: f"SELECT o_orderkey, o_totalprice FROM ({LOGGED}) AS t WHERE o_totalprice > 400000",
    table_source: f"SELECT * FROM ({NOW}) AS t WHERE o_orderpriority = '2-HIGH' AND o_totalprice BETWEEN 1000 AND 300000",
    table_source_scan: LOGGED,
    table_file_pruned: "SELECT o_orderkey, o_totalprice, (SELECT count(DISTINCT floor(o_totalprice / 100000)) FROM orders WHERE o_totalprice < 150000) AS n_files FROM orders WHERE o_totalprice < 150000",
    table_keygen: f"{MONTHS} SELECT o_orderkey, secs, (SELECT count(DISTINCT month) FROM o WHERE month <= (SELECT strftime(make_timestamp(cut * 1000000), '%Y/%m') FROM c)) AS n_partitions FROM o, c WHERE secs <= cut AND month IN (SELECT month FROM m)",
    table_meta_columns: f"SELECT CASE WHEN o_orderkey % 10 = 3 THEN '{C2}' ELSE '{C1}' END AS instant, count(*) AS n FROM ({NOW}) AS t GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM ({NOW}) AS t",
    table_file_slices: "SELECT DISTINCT 'o_orderpriority=' || o_orderpriority AS partition, 1::BIGINT AS n_logs FROM orders",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: sql_query(v) for k, v in SQL.items()} | {f.__name__: f for f in TABLE_QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL | {f.__name__: v for f, v in TABLE_QUERIES.items()}
