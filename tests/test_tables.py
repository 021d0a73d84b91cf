"""Tables written here and read back: merges, time travel, incremental reads, the metadata table, and the parts they rest on."""

import io
import json
import struct

import pytest
from pyspark.sql import functions as F

from tidelake.errors import ConfigError, CorruptFileError, SchemaError, TableError, TimelineError, UnsupportedError
from tidelake.functions.timestamps import normalise
from tidelake.operators.filters import Filter, col, split_values
from tidelake.operators.prune import partition_values
from tidelake.plans import groups, metadata
from tidelake.plans.config import META_FIELDS, ReadOptions, TableConfig
from tidelake.plans.timeline import parse_instant
from tidelake.sources import hfile, logfile
from tidelake.sources.datasource import TableReader, create_table, register, support, to_filter
from tidelake.sources.writer import TableWriter
from tidelake.streaming.incremental import IncrementalFollower
from tidelake.table import Table

T1, T2, T3, T4 = (f"2024010{d}000000000" for d in range(1, 5))
COLUMNS = ["ts", "uuid", "rider", "fare", "city"]
SCHEMA = json.dumps({"type": "record", "name": "trips", "fields": [{"name": c, "type": ["null", {"ts": "long", "fare": "double"}.get(c, "string")]} for c in COLUMNS]})
DDL = "ts long, uuid string, rider string, fare double, city string"
RIDERS = "ACDEFGIJ"


def writer(spark, path, kind="MERGE_ON_READ", version="8", **more):
    return TableWriter(spark, str(path), SCHEMA, table__name="trips", table__type=kind, table__version=version, table__recordkey__fields="uuid", table__ordering__fields="ts", **more)


def trips(spark, riders, ts=1, fare=10.0):
    return spark.createDataFrame([(ts, f"id-{r}", f"rider-{r}", fare, "sf") for r in riders], DDL)


def rows_block(w, df, time):
    return w.data_block(w.meta(df, "", "", time).select(*META_FIELDS, *COLUMNS).toArrow(), time)


def fares(df):
    return {r["rider"][-1]: r["fare"] for r in df.select("rider", "fare").collect()}


@pytest.fixture
def mor(spark, tmp_path):
    """Eight inserts; A, G and J set to 0; F and J deleted; a change of C that is rolled back."""
    w = writer(spark, tmp_path / "trips")
    w.base(trips(spark, RIDERS), "", "g1-0", T1)
    w.commit(T1, "deltacommit")
    w.log("", "g1-0", T2, [rows_block(w, trips(spark, "AGJ", 2, 0.0), T2)])
    w.commit(T2, "deltacommit")
    w.log("", "g1-0", T3, [w.delete_block([("id-F", 3), ("id-J", 3)], T3)])
    w.commit(T3, "deltacommit")
    w.log("", "g1-0", T4, [rows_block(w, trips(spark, "C", 9, 99.0), "20240103120000000"), w.rollback_block("20240103120000000", T4)])
    w.commit(T4, "deltacommit")
    return str(tmp_path / "trips")


def test_merge_on_read(spark, mor):
    t = Table.open(spark, mor)
    assert fares(t.read()) == {"A": 0.0, "G": 0.0, "C": 10.0, "D": 10.0, "E": 10.0, "I": 10.0}
    assert fares(t.read(ReadOptions().with_as_of(T1))) == dict.fromkeys(RIDERS, 10.0)
    assert fares(t.read(ReadOptions().with_as_of(T2)))["J"] == 0.0
    assert fares(t.read(ReadOptions().with_read_optimized())) == dict.fromkeys(RIDERS, 10.0)
    assert t.read(ReadOptions().with_as_of("20230101000000000")).count() == 0
    assert [len(s.logs) for s in t.file_slices()] == [3]


def test_filter_after_merge(spark, mor):
    t = Table.open(spark, mor)
    # the old row of A has a fare of 10; a filter below the merge would bring it back
    assert "A" not in fares(t.read(ReadOptions().with_filters(("fare", ">", "5"))))
    assert t.read(ReadOptions().with_filters(col("fare").lte(0)).with_projection("uuid")).columns == ["uuid"]
    with pytest.raises(SchemaError):
        t.read(ReadOptions().with_filters(("nowhere", "=", "1")))
    with pytest.raises(SchemaError):
        t.read(ReadOptions().with_projection("nowhere"))


def test_incremental_merge_on_read(spark, mor):
    t = Table.open(spark, mor)
    some = ReadOptions().with_query_type("incremental").with_start(T1)
    assert fares(t.read(some.with_end(T2))) == {"A": 0.0, "G": 0.0, "J": 0.0}
    assert fares(t.read(some)) == {"A": 0.0, "G": 0.0}
    assert t.read(some.with_start(T4)).count() == 0


@pytest.mark.parametrize(("ordering", "stays"), [(1, True), (2, False), (3, False), (0, False)])
def test_tombstones(spark, tmp_path, ordering, stays):
    """A deletion wins by a greater ordering value, by a later commit at the same one, or by a later commit if its own is 0."""
    w = writer(spark, tmp_path / "t")
    w.base(trips(spark, "A", ts=2), "", "g1-0", T1)
    w.commit(T1, "deltacommit")
    w.log("", "g1-0", T2, [w.delete_block([("id-A", ordering)], T2)])
    w.commit(T2, "deltacommit")
    assert (Table.open(spark, str(tmp_path / "t")).read().count() == 1) == stays


def test_uncompleted_files_are_hidden(spark, mor):
    w = TableWriter.__new__(TableWriter)
    t = Table.open(spark, mor)
    w.spark, w.storage, w.stats, w.keys, w.latest = spark, t.storage, {}, ["uuid"], {}
    w.log("", "g1-0", "20240109000000000", [rows_block(w, trips(spark, "D", 50, 77.0), "20240109000000000")])
    w.base(trips(spark, "Z"), "", "g2-0", "20240109000000000")
    assert fares(Table.open(spark, mor).read())["D"] == 10.0
    assert len(Table.open(spark, mor).file_slices()) == 1


@pytest.fixture
def overwritten(spark, tmp_path):
    w = writer(spark, tmp_path / "o", kind="COPY_ON_WRITE")
    for n, (time, riders, action) in enumerate(((T1, "ABC", "commit"), (T2, "AD", "replacecommit"), (T3, "D", "replacecommit"))):
        w.base(trips(spark, riders, n, float(n)), "", f"g{n}-0", time)
        w.commit(time, action, replaced={"": [f"g{n - 1}-0"]} if n else None, operation="insert_overwrite_table" if n else "insert")
    return str(tmp_path / "o")


def test_incremental_over_replaced_groups(spark, overwritten):
    t = Table.open(spark, overwritten)

    def between(start, end=None):
        o = ReadOptions().with_query_type("incremental").with_start(start)
        return "".join(sorted(fares(t.read(o.with_end(end) if end else o))))

    assert between("19700101000000000", T1) == "ABC"
    assert between(T1, T2) == "AD"
    assert between(T2, T3) == "D"
    assert between(T1) == "D"
    assert fares(t.read()) == {"D": 2.0}
    assert sorted(fares(t.read(ReadOptions().with_as_of(T1)))) == list("ABC")
    assert [i.time for i in t.timeline.commits("replacecommit", newest_first=True)] == [T3, T2]


def test_batches_and_follower(spark, mor, tmp_path):
    t = Table.open(spark, mor)
    assert [b.num_rows for b in t.read_stream(ReadOptions().with_batch_size(4))] == [4, 2]
    with pytest.raises(UnsupportedError):
        next(t.read_stream(ReadOptions().with_query_type("incremental")))
    seen = []
    f = IncrementalFollower(spark, mor, lambda df, n: seen.append((n, df.count())), str(tmp_path / "check"))
    assert f.run_once() and not f.run_once()
    assert seen == [(0, 6)]


def test_slices_and_paths(spark, mor):
    t = Table.open(spark, mor)
    (s,) = t.file_slices()
    assert t.read_file_slice(s).count() == 6
    assert t.read_file_slice_from_paths(s.base_path).count() == 8
    with pytest.raises(ConfigError):
        t.read_file_slice_from_paths("nothing.parquet")
    assert t.file_slices_splits(3) == [[s]]


def test_view(spark, mor):
    Table.open(spark, mor).create_view("trips_view")
    assert spark.sql("SELECT count(*) FROM trips_view WHERE fare = 0").first()[0] == 2


# -- the metadata table

@pytest.mark.parametrize("gzip", [False, True])
def test_metadata_table(spark, tmp_path, gzip):
    w = writer(spark, tmp_path / "d", kind="COPY_ON_WRITE", table__metadata__partitions="files")
    names = []
    for n, r in enumerate("ABC"):
        w.base(trips(spark, r), "", f"g{n}-0", T1)
        names.append(f"g{n}-0_0-0-0_{T1}.parquet")
    w.commit(T1)
    w.metadata_table({"": {names[0]: (5, False), names[1]: (5, False)}}, T1, [(T2, {"": {names[1]: (0, True), names[2]: (7, False)}})], gzip)
    t = Table.open(spark, str(tmp_path / "d"))
    assert t.has_metadata_table
    assert sorted(fares(t.read())) == ["A", "C"]  # a listing would show B too
    assert sorted(s.size for s in t.file_slices()) == [5, 7]
    t.storage.delete(".hoodie/metadata/files")
    assert sorted(fares(t.read())) == ["A", "B", "C"]  # by listing
    assert not Table.open(spark, str(tmp_path / "d"), {"hoodie.metadata.enable": "false"}).has_metadata_table


def test_metadata_fold():
    start = metadata.fold({}, iter([("p", {"a": {"size": 9, "isDeleted": False}, "b": {"size": 1, "isDeleted": True}})]))
    assert start == {"p": {"a": 9, "b": None}}
    later = metadata.fold(start, iter([("p", {"a": {"size": 4, "isDeleted": False}, "b": {"size": 0, "isDeleted": True}, "c": {"size": 2, "isDeleted": False}})]))
    assert later == {"p": {"a": 9, "b": None, "c": 2}}
    assert metadata.fold(later, iter([("p", {"a": {"size": 0, "isDeleted": True}})])) == {"p": {"b": None, "c": 2}}


@pytest.mark.parametrize("gzip", [False, True])
def test_index_file(gzip):
    want = {f"key-{i:03}": bytes([i]) * i for i in range(25)}
    f = hfile.IndexFile(hfile.build(want, {"schema": b"{}"}, gzip, per_block=7))
    assert dict(f) == want and f.info() == {"schema": b"{}"}
    assert f.lookup(["key-003", "none"]) == {"key-003": want["key-003"]}
    assert len(f.prefixed("key-01")) == 10
    assert dict(hfile.IndexFile(hfile.build({}, {}))) == {}
    with pytest.raises(CorruptFileError):
        hfile.IndexFile(b"short")


# -- parts

def test_timestamps():
    want = "20240102030405006"
    assert normalise(want) == want
    assert normalise("20240102030405") == "20240102030405000"
    assert {normalise(s) for s in ("2024-01-02T03:04:05.006Z", "2024-01-02T04:04:05.006+01:00", "1704164645006", "1704164645006000", "1704164645006000000")} == {want}
    assert normalise("1704164645") == "20240102030405000"
    with pytest.raises(TimelineError):
        normalise("yesterday")


def test_instants():
    assert parse_instant("20240102030405.commit", 1).state == "completed"
    assert (i := parse_instant("20240102030405.inflight", 1)).action == "commit" and i.state == "inflight"
    assert parse_instant(f"{T1}_{T2}.deltacommit", 2).completion == T2
    assert parse_instant("hoodie.properties", 1) is None
    with pytest.raises(TimelineError):
        parse_instant(f"{T1}_{T2}.commit", 1)


def test_filters():
    assert split_values(r"a, b\,c,,d\\") == ["a", "b,c", "d\\"]
    assert (~Filter.of("x", "in", "1,2")).op == (~~Filter.of("x", "NOT IN", "1,2")).op
    assert (~Filter.of("x", "<", "1")).op == ">="
    with pytest.raises(UnsupportedError):
        Filter.of("x", "like", "a")
    with pytest.raises(UnsupportedError):
        Filter.of("x", "in", "")


def test_filters_on_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "n int, s string")
    count = lambda f: df.where(f.condition(df.schema[f.column].dataType)).count()
    assert [count(f) for f in (col("n").eq(1), col("n").ne(1), col("n").lt(2), col("n").gte(1), col("s").in_list(["a", "c"]), col("n").not_in_list([1]))] == [1, 1, 1, 2, 2, 1]


def test_log_attachment():
    g = groups.FileGroup("", "g", {t: groups.FileSlice("", "g", t, f"g_0_{t}.parquet") for t in (T1, T3)})
    log = lambda time: groups.parse_log(f".g_{time}.log.1_0-0-0")
    g.attach(log(T2), {T2: T4}, 2)  # begun before the second slice and completed after it
    g.attach(log(T1), {}, 1)
    assert [len(s.logs) for s in (g.slices[T1], g.slices[T3])] == [1, 1]
    with pytest.raises(CorruptFileError):
        g.attach(log("20200101000000000"), {}, 1)
    assert g.as_of(T2).time == T1 and g.as_of("20200101000000000") is None


def test_log_files_that_end_early():
    block = logfile.frame(logfile.COMMAND, {logfile.INSTANT_TIME: T1}, b"x" * 20)
    assert len(list(logfile.blocks(block * 2))) == 2
    for data in (block[:-40], b"garbage" * 9):
        with pytest.raises(CorruptFileError):
            list(logfile.blocks(data))
    with pytest.raises(UnsupportedError):
        logfile.deletes(logfile.Block(logfile.DELETE, {}, io.BytesIO(struct.pack(">II", 1, 0)), 0, 8))


def test_options_and_properties(spark, tmp_path):
    o = ReadOptions().with_option("hoodie.read.as.of.timestamp", "20240101000000").with_option("hoodie.read.stream.batch_size", "7")
    assert (o.resolved("utc").as_of, o.batch_size) == (T1, 7)
    for bad in (lambda: ReadOptions().with_query_type("cdc"), lambda: ReadOptions().with_batch_size(0), lambda: Table.open(spark, str(tmp_path / "none"))):
        with pytest.raises(ConfigError):
            bad()
    good = {"hoodie.table.name": "t", "hoodie.table.type": "COPY_ON_WRITE", "hoodie.table.version": "6"}
    TableConfig(good).validate()
    for change in ({"hoodie.table.version": "5"}, {"hoodie.table.type": "X"}, {"hoodie.table.name": ""}, {"hoodie.table.base.file.format": "lance"}, {"hoodie.timeline.layout.version": "2"}):
        with pytest.raises(TableError):
            TableConfig(good | change).validate()


def test_partition_pruning(spark, tmp_path):
    w = writer(spark, tmp_path / "p", kind="COPY_ON_WRITE", version="6", table__partition__fields="city", datasource__write__hive_style_partitioning="true")
    for n, city in enumerate(("sf", "la")):
        w.base(trips(spark, "A").withColumn("city", F.lit(city)), f"city={city}", f"g{n}-0", T1)
    w.commit(T1)
    t = Table.open(spark, str(tmp_path / "p"))
    assert [s.partition for s in t.file_slices(ReadOptions().with_filters(("city", "=", "la")))] == ["city=la"]
    assert t.file_slices(ReadOptions().with_filters(("city", "NOT IN", "la,sf"))) == []
    assert t.partition_schema().fieldNames() == ["city"]
    assert partition_values("city=la", ["city"], t.schema(), True, False) == {"city": "la"}


def test_empty_table(spark, tmp_path):
    w = writer(spark, tmp_path / "e", table__create__schema=SCHEMA.replace(": ", ":"))
    t = Table.open(spark, w.storage.base)
    df = t.read()
    assert df.count() == 0 and df.columns[-len(COLUMNS) :] == COLUMNS


def test_footers(spark, tmp_path, monkeypatch):
    w = writer(spark, tmp_path / "f", kind="COPY_ON_WRITE")
    for n, fare in enumerate((1.0, 50.0)):
        w.base(trips(spark, "AB", fare=fare), "", f"g{n}-0", T1)
    w.commit(T1)
    some = ReadOptions().with_filters(("fare", ">", "20"))
    for guess in (1 << 16, 16):  # the second is too short for any footer
        monkeypatch.setattr("tidelake.sources.storage.FOOTER_GUESS", guess)
        t = Table.open(spark, str(tmp_path / "f"), {"hoodie.plan.prune.files": "true"})
        assert [s.file_id for s in t.file_slices(some)] == ["g1-0"]
        assert len(t.file_slices()) == 2 and t.stats()[0] == pytest.approx(4, abs=1)
    t = Table.open(spark, str(tmp_path / "f"))
    assert len(t.file_slices(some.with_option("hoodie.plan.prune.files", "false"))) == 2  # on by default
    monkeypatch.setattr("tidelake.table.FOOTERS_HERE", 1)  # by tasks
    assert [s.file_id for s in t.file_slices(some)] == ["g1-0"] == [s.file_id for s in t.file_slices(ReadOptions().with_filters(("fare", ">=", "50.0")))]
    assert groups.totals(t.with_rows(t.file_slices()))[0] == pytest.approx(4, abs=1)
    assert groups.totals(t.file_slices())[0] is None


def test_log_files_of_a_store_that_arrow_does_not_know(spark, mor, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.tables.link./t", f"file://{mor}")
    want = sorted(map(tuple, Table.open(spark, mor).read().collect()))
    assert sorted(map(tuple, Table.open(spark, "viewfs://tables/t").read().collect())) == want


@pytest.mark.parametrize("name", ["table_logs", "table_rollback", "table_slice", "table_source_scan", "table_tombstones"])
def test_log_records_do_not_pass_the_driver(spark, monkeypatch, name):
    """Tasks write the log files: the driver gets their numbers, whatever the orders."""
    from tidelake.plans import queries
    from tidelake.sources.writer import LOG_FILES

    frame, got = type(spark.range(0)), [0]
    for method, rows in (("collect", len), ("toArrow", lambda t: t.num_rows)):
        monkeypatch.setattr(frame, method, lambda self, f=getattr(frame, method), rows=rows: (out := f(self), got.append(rows(out)))[0])
    made = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert max(got) <= LOG_FILES
    monkeypatch.undo()
    assert made.count() > 0


@pytest.mark.parametrize("store", ["file", "viewfs"])
def test_log_files_written_by_tasks(spark, tmp_path, store):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.written.link./w", f"file://{tmp_path}")
    w = writer(spark, f"viewfs://written/w/{store}" if store == "viewfs" else tmp_path / store)
    w.base(trips(spark, RIDERS), "", "g1-0", T1)
    w.commit(T1, "deltacommit")
    changed = trips(spark, "ACDE", 2, 0.0).repartition(3)
    n = w.logs("", "g1-0", T2, w.meta(changed, "", "", T2).select(*META_FIELDS, *COLUMNS), lambda rows: TableWriter.data_block(rows, T2))
    gone = spark.createDataFrame([("id-F", 3)], "key string, ts long")
    n = w.logs("", "g1-0", T2, gone, lambda rows: TableWriter.delete_block([tuple(r.values()) for r in rows.to_pylist()], T2), version=n)
    assert n > max(groups.parse_log(f.name).version for f in w.storage.listing("")[0] if f.name.startswith(".g1-0"))
    w.commit(T2, "deltacommit")
    t = Table.open(spark, w.storage.base)
    assert fares(t.read()) == dict.fromkeys("ACDE", 0.0) | dict.fromkeys("GIJ", 10.0)
    assert fares(t.read(ReadOptions().with_query_type("incremental").with_start(T1))) == dict.fromkeys("ACDE", 0.0)


def test_source_plans_what_catalyst_hands_it(spark, tmp_path):
    from pyspark.sql import datasource as ds

    w = writer(spark, tmp_path / "p", table__partition__fields="city", datasource__write__hive_style_partitioning="true")
    for city, fare in (("sf", 1.0), ("la", 50.0), ("ny", 90.0)):
        w.base(trips(spark, "AB", fare=fare).withColumn("city", F.lit(city)), f"city={city}", f"{city}-0", T1)
    w.commit(T1, "deltacommit")
    w.log("city=la", "la-0", T2, [rows_block(w, trips(spark, "B", 9, 3.0).withColumn("city", F.lit("la")), T2), w.delete_block([("id-A", 9)], T2)])
    w.commit(T2, "deltacommit")
    register(spark)
    path = str(tmp_path / "p")
    df = spark.read.format("tidelake").load(path)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, Table.open(spark, path).read().collect()))
    assert {(r.city, r.fare) for r in df.where("city = 'la'").collect()} == {("la", 3.0)}

    def planned(*filters):
        reader = TableReader({"path": path}, df.schema)
        rest = list(reader.pushFilters(list(filters)))
        return {s.partition for p in reader.partitions() for s in p.slices}, [support(f, reader.table) for f in filters], len(rest)

    city = lambda v: ds.EqualTo(("city",), v)
    assert planned() == ({"city=sf", "city=la", "city=ny"}, [], 0)
    assert planned(city("la")) == ({"city=la"}, ["exact"], 0)
    assert planned(ds.Not(city("la"))) == ({"city=sf", "city=ny"}, ["inexact"], 1)
    assert planned(ds.In(("city",), ("sf", "xx")), ds.StringContains(("rider",), "A")) == ({"city=sf"}, ["inexact", "unsupported"], 2)
    assert planned(ds.GreaterThan(("city",), "m"), ds.IsNotNull(("city",)), ds.LessThanOrEqual(("ts",), 5)) == ({"city=sf", "city=ny"}, ["inexact", "unsupported", "inexact"], 3)
    assert to_filter(ds.Not(ds.Not(ds.EqualTo(("a", "b"), True)))) == Filter("a.b", "=", ("true",)) and to_filter(ds.EqualTo(("a",), b"x")) is None

    create_table(spark, "trips_of_the_source", path)
    ask = "SELECT count(*) FROM trips_of_the_source WHERE city = 'sf'"
    assert spark.sql(ask).first()[0] == 2
    w.base(trips(spark, "C").withColumn("city", F.lit("sf")), "city=sf", "sf-1", T3)
    w.commit(T3, "deltacommit")
    assert spark.sql(ask).first()[0] == 3  # planned anew
    then = spark.read.format("tidelake").option("hoodie.read.as.of.timestamp", T1).option("hoodie.read.input.partitions", "2").load(path)
    assert then.count() == 6 and len(TableReader({"path": path, "hoodie.read.input.partitions": "2"}, df.schema).partitions()) == 2
    spark.sql("DROP TABLE trips_of_the_source")
    with pytest.raises(Exception, match="path"):
        spark.read.format("tidelake").load().count()


def test_merge_in_memory_agrees_with_spark(spark, tmp_path):
    from tidelake.plans import fixtures

    path = fixtures.orders_logs(spark, "/root/testdata/sf0.001")
    register(spark)
    assert sorted(map(tuple, spark.read.format("tidelake").load(path).collect())) == sorted(map(tuple, Table.open(spark, path).read().collect()))


@pytest.mark.parametrize("strategy", ["", "APPEND_ONLY"])
def test_large_slices_are_merged_by_parts(spark, monkeypatch, strategy):
    """1,500 orders and their logs in one slice: no merge holds more than a part of them."""
    from tidelake.plans import fixtures
    from tidelake.sources import datasource

    path, seen, merged = fixtures.orders_logs(spark, "/root/testdata/sf0.001"), [0], datasource.latest_rows
    monkeypatch.setattr(datasource, "MERGE_ROWS", 100, raising=False)
    monkeypatch.setattr(datasource, "DEALT_ROWS", 64, raising=False)
    monkeypatch.setattr(datasource, "latest_rows", lambda rows, dead, ordering: (seen.append(rows.num_rows + dead.num_rows), merged(rows, dead, ordering))[1])
    reader = TableReader({"path": path}, Table.open(spark, path).schema(meta_fields=True))
    reader.strategy = strategy or reader.strategy
    got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    if strategy:
        assert len(got) == 1500 + 450 and max(seen) == 0
    else:
        assert sorted(got) == sorted(map(tuple, Table.open(spark, path).read().collect()))
        assert max(seen) < 500


@pytest.mark.parametrize("version", ["6", "8"])
def test_archived_instants(spark, tmp_path, version):
    w = writer(spark, tmp_path / "a", kind="COPY_ON_WRITE", version=version)
    for n, (rider, t) in enumerate((("A", T2), ("B", T3))):
        w.base(trips(spark, rider), "", f"g{n}-0", t)
        w.commit(t)
    w.base(trips(spark, "C"), "", "g2-0", T4)  # under way
    w.base(trips(spark, "D"), "", "g3-0", T1)  # failed long ago, and still in the timeline
    folder = ".hoodie/timeline" if version == "8" else ".hoodie"
    w.storage.write(b"", folder, f"{T1}.commit.inflight" if version == "8" else f"{T1}.inflight")
    w.archive(T2)
    path = str(tmp_path / "a")
    t = Table.open(spark, path)
    assert set(fares(t.read())) == {"A", "B"} and [i.time for i in t.timeline.commits()] == [T3]
    t = Table.open(spark, path, {"hoodie.internal.timeline.archived.enabled": "true"})
    assert [i.time for i in t.timeline.commits()] == [T2, T3] and t.timeline.latest == T3
    since = ReadOptions().with_query_type("incremental")
    assert set(fares(t.read(since.with_start(T1)))) == {"A", "B"} and set(fares(t.read(since.with_end(T2)))) == {"A"}


def test_follower_gets_late_completions(spark, tmp_path):
    w, got = writer(spark, tmp_path / "f", kind="COPY_ON_WRITE"), []
    follower = IncrementalFollower(spark, str(tmp_path / "f"), lambda df, n: got.append((n, sorted(fares(df)))), str(tmp_path / "c"))
    for rider, t, done in (("A", T1, T1), ("C", T3, T3), ("B", T2, T4)):  # T2 began before T3 and ended after it
        w.base(trips(spark, rider), "", f"{rider}-0", t)
        w.commit(t, completion=done)
        assert follower.run_once() and not follower.run_once()
    assert got == [(0, ["A"]), (1, ["C"]), (2, ["B"])]


def test_one_slice_with_options(spark, mor):
    t = Table.open(spark, mor)
    s = t.file_slices()[0]
    some = ReadOptions().with_filters(("rider", "IN", "rider-C,rider-D")).with_projection("rider")
    assert sorted(r.rider for r in t.read_file_slice(s, some).collect()) == ["rider-C", "rider-D"] and t.read_file_slice(s, some).columns == ["rider"]
    assert sum(b.num_rows for b in t.read_file_slice_stream(s, some.with_batch_size(1))) == 2
    assert t.read_file_slice(s, ReadOptions().with_read_optimized()).count() == 8


def test_filters_that_cannot_be_compared_prune_nothing():
    from datetime import UTC, datetime
    from decimal import Decimal

    assert Filter.of("a", "=", "x").may_hold(Decimal(1), Decimal(2)) and Filter.of("a", "<", "x").holds(Decimal(1))
    assert Filter.of("a", ">", "2024-01-01T00:00:00").may_hold(datetime(2020, 1, 1, tzinfo=UTC), datetime(2021, 1, 1, tzinfo=UTC))
    assert not Filter.of("a", ">", "2024-01-01T00:00:00+00:00").may_hold(datetime(2020, 1, 1, tzinfo=UTC), datetime(2021, 1, 1, tzinfo=UTC))
    with pytest.raises(UnsupportedError):
        ReadOptions().with_filters(("a", "~", "1"))
    for key in ("hoodie.read.nothing", "other"):
        with pytest.raises(ConfigError):
            ReadOptions().with_option(key, "1")


@pytest.mark.parametrize("leaf", [0, 3])
def test_index_files_by_their_block_index(leaf):
    records = {f"key-{n:04d}" + "x" * (200 if n == 77 else 0): str(n).encode() for n in range(100)}
    f = hfile.IndexFile(hfile.build(records, {"schema": b"s"}, per_leaf=leaf))
    assert dict(f) == records and f.info() == {"schema": b"s"}
    decoded = []
    f._records, real = lambda at: decoded.append(at) or real(at), f._records
    assert f.lookup(["key-0000", "key-0050", "key-0051", "nothing", "key-9", "a"]) == {"key-0000": b"0", "key-0050": b"50", "key-0051": b"51"}
    assert len(decoded) == 3
    assert f.prefixed("key-001") == {k: v for k, v in records.items() if k.startswith("key-001")} and len(decoded) == 10
    assert not f.prefixed("zzz") and not f.prefixed("a") and list(hfile.IndexFile(hfile.build({}, {}))) == []


def test_formats_by_extension():
    assert groups.format_of("x.parquet") == "parquet" == groups.format_of("x.lance", "parquet") and groups.format_of("x.LANCE") == "lance"
    assert groups.parse_base("a_0_20240101000000000.lance") and not groups.parse_base("a_0_20240101000000000.txt")


def test_times_in_the_local_zone(monkeypatch):
    import time

    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        assert normalise("1704164645", "local") == "20240102120405000" == normalise("2024-01-02T03:04:05Z", "local")
        assert normalise("20240102030405", "local") == "20240102030405000" == normalise("2024-01-02T03:04:05", "local")
    finally:
        monkeypatch.undo()
        time.tzset()
    with pytest.raises(TimelineError):
        normalise("1704164645", "mars")
