"""The engine's scenarios: writes, time travel, deletes, restore, clone, imports and the log."""
import datetime as dt
import json
import random
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeledger import FileSet, LakeTable, Location, common, merge, register_settings, same, union, unregister_settings
from lakeledger.plans import log as L
from lakeledger.sources.storage import absolute, normal, settings_for


def typed(seed, n=11, start=0, **extra):
    r = random.Random(seed)
    day = dt.datetime(2024, 1, 1)
    cols = {
        "flag": pa.array([r.random() < 0.5 for _ in range(n)]), "tiny": pa.array([r.randrange(-128, 128) for _ in range(n)], pa.int8()),
        "big": pa.array([r.randrange(-2**60, 2**60) for _ in range(n)]), "day": pa.array([day.date() + dt.timedelta(r.randrange(9000)) for _ in range(n)]),
        "naive": pa.array([day + dt.timedelta(seconds=r.randrange(10**8)) for _ in range(n)], pa.timestamp("us")),
        "real": pa.array([r.random() for _ in range(n)]), "blob": pa.array([r.randbytes(10) for _ in range(n)]),
        "cat": pa.array([r.choice("SAD") for _ in range(n)]), "bat": pa.array([r.choice([1, 2, 3]) for _ in range(n)], pa.int64()),
        "order": pa.array(range(start, start + n), pa.int64())}
    return pa.table({**cols, **{k: pa.array([r.random() for _ in range(n)]) for k in extra}})


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, df.select(*[f"`{c}`" for c in cols]).collect()))


@pytest.fixture
def table(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "t"))
    for i in range(3):
        t = t.write(typed(i, start=11 * i), partition_by=["cat", "bat"])
    return t


def test_appends_equal_union(spark, table):
    assert rows(table.df()) == rows(union(spark, [typed(i, start=11 * i) for i in range(3)]))
    assert table.count() == 33 and table.version() == 2 and table.versions() == [0, 1, 2]
    assert dict(table.df().dtypes)["naive"] == "timestamp_ntz"


def test_time_travel_overwrite_delete_restore_clone(spark, table, tmp_path):
    t = table.write(typed(9), mode="overwrite")
    assert t.count() == 11 and rows(t.at_version(2).df()) == rows(table.df())
    p = "cat = 'A' OR real > 0.9"
    d = table.at_version(2)
    with pytest.raises(FileExistsError):  # a stale handle
        d.delete(p)
    d = t.restore(2)
    assert d.version() == 4 and rows(d.df()) == rows(table.df())
    d = d.delete(p)
    assert rows(d.df()) == rows(table.df().where(f"NOT ({p})"))
    c = d.clone(str(tmp_path / "c"))
    for v in c.versions():
        assert rows(c.at_version(v).df()) == rows(d.at_version(v).df())
    c2 = c.write(typed(20))
    assert c2.count() == c.count() + 11 and LakeTable(spark, d.root.url).version() == d.version()
    with pytest.raises(FileExistsError):
        d.clone(str(tmp_path / "c"))
    assert d.delete().df().count() == 0
    for bad in (99, -1):
        with pytest.raises(ValueError):
            d.at_version(bad)


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_partition_columns_cannot_change(table, mode):
    for by in (["cat"], [], ["cat", "bat", "flag"]):
        with pytest.raises(ValueError):
            table.write(typed(5), mode=mode, partition_by=by)
    for by in (None, ["bat", "cat"]):
        assert table.__class__(table.spark, table.root).write(typed(5), mode=mode, partition_by=by).partition_columns() == ["cat", "bat"]


def test_schema_rules(spark, table):
    with pytest.raises(ValueError, match="Schema mismatch"):
        table.write(typed(3, new=1))
    t = table.write(typed(3, new=1), schema_mode="merge")
    assert t.df().where("new is not null").count() == 11 and t.schema().names[-1] == "new"
    assert t.snapshot.meta["id"] == table.snapshot.meta["id"]
    with pytest.raises(ValueError):
        t.write(typed(4).set_column(0, "flag", pa.array(["x"] * 11)), schema_mode="merge")
    permuted = typed(6).select(list(reversed(typed(6).column_names)))
    t2 = t.write(permuted, schema_mode="merge")
    assert t2.schema() == t.schema()
    o = t2.write(pa.table({"z": [1], "cat": ["a"], "bat": pa.array([1], pa.int64())}), mode="overwrite")
    assert set(o.schema().names) == {"z", "cat", "bat"} and rows(o.restore(2).df()) == rows(table.df())


def test_modes_and_missing_table(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "m"))
    for call in (t.version, t.df, t.schema):
        with pytest.raises(ValueError):
            call()
    t = t.write(typed(1), mode="ignore")
    assert t.write(typed(2), mode="ignore") is t and t.history()[0]["operation"] == "CREATE TABLE"
    with pytest.raises(FileExistsError):
        t.write(typed(2), mode="error")
    with pytest.raises(ValueError):
        t.write(typed(2), mode="sideways")


def test_inputs(spark, tmp_path):
    a, b = typed(1), typed(2, start=11)
    want = rows(union(spark, [a, b]))
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "p"))
    kinds = [[a, b], (x for x in (a, b)), [*a.to_batches(), *b.to_batches()], [union(spark, a), b]]
    for i, data in enumerate(kinds):
        assert rows(LakeTable(spark, str(tmp_path / f"k{i}")).write(data).df()) == want
    pdf = LakeTable(spark, str(tmp_path / "pd")).write([a.drop(["blob"]).to_pandas()])
    assert pdf.count() == 11
    assert union(spark, str(tmp_path / "p")).count() == 1
    unsigned = pa.table({"u": pa.array([200], pa.uint8()), "w": pa.array([2**63], pa.uint64())})
    assert union(spark, unsigned).collect()[0][:] == (200, 2**63)
    with pytest.raises(TypeError):
        union(spark, 7)


def test_schema_algebra():
    x, y = T.StructType().add("a", "integer").add("b", "string"), T.StructType().add("b", "string").add("a", "integer").add("c", "long")
    assert merge(x, y).names == ["a", "b", "c"] and common(x, y).names == ["a", "b"] and not same(x, y)
    assert same(x, T.StructType().add("b", "string").add("a", "integer"))
    with pytest.raises(ValueError):
        merge(x, T.StructType().add("a", "long"))


def test_delete_null_and_row_groups(spark, tmp_path):
    df = spark.range(0, 300_000, 1, 1).selectExpr("id", "case when id % 3 = 0 then null else id end as v")
    t = LakeTable(spark, str(tmp_path / "d")).write(df, options={"parquet.block.size": "65536", "parquet.page.row.count.limit": "1000"})
    d = t.delete("v = 100000")
    assert d.count() == 300_000 - 100_000 - 1  # nulls go too
    assert d.restore(0).delete("v = 100000", null_safe=True).count() == 299_999
    m = d.history()[0]["operationMetrics"]
    assert (m["num_copied_rows"], m["num_deleted_rows"]) == (199_999, 100_001)
    n = LakeTable(spark, t.root).delete("id < 0")
    assert n.history()[0]["operationMetrics"]["num_removed_files"] == 0


def test_odd_partition_values(spark, tmp_path):
    values = ["a b", "x=y", "p/q", "50%", "Ünï", "plus+", None, "c:d"]
    t = LakeTable(spark, str(tmp_path / "odd dir")).write(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k string, i long"), partition_by=["k"])
    want = sorted((str(v), i) for i, v in enumerate(values))
    assert sorted((str(r.k), r.i) for r in t.df().collect()) == want
    d = t.delete("i in (0, 3)")
    assert sorted(r.i for r in d.df().collect()) == [1, 2, 4, 5, 6, 7]
    c = t.clone(str(tmp_path / "copy"))
    assert sorted((str(r.k), r.i) for r in c.df().collect()) == want
    assert sorted(r.i for r in c.delete("i = 4").df().collect()) == [0, 1, 2, 3, 5, 6, 7]


def test_import_layouts(spark, tmp_path):
    base = union(spark, typed(1)).drop("cat", "bat", "blob")
    parts = T.StructType().add("cat", "string").add("bat", "long")
    base.coalesce(1).write.parquet(str(tmp_path / "h/cat=S/bat=1/flag2=true"))
    base.coalesce(1).write.parquet(str(tmp_path / "g/A/2"))
    base.coalesce(1).write.parquet(str(tmp_path / "s"))
    file = next(f[0] for f in Location.of(spark, str(tmp_path / "s")).files() if f[0].endswith(".parquet"))
    Location(spark, file).rename(Location.of(spark, str(tmp_path / "f/D_3_part-0.parquet")))
    t = LakeTable(spark, str(tmp_path / "t")).import_files(
        [FileSet(str(tmp_path / "h"), "hive", parts), FileSet(str(tmp_path / "g"), "directory", parts), FileSet(str(tmp_path / "f"), "filename", parts)],
        partition_by=["cat", "bat"])
    assert t.count() == 33 and {tuple(r) for r in t.df().select("cat", "bat").distinct().collect()} == {("S", 1), ("A", 2), ("D", 3)}
    assert t.df("cat = 'A'").count() == 11 and len(t.file_urls()) == 3
    with pytest.raises(TypeError):
        t.import_files(typed(1))
    d = t.delete("cat = 'S'")
    assert d.df().count() == 22
    with pytest.raises(FileExistsError):
        d.import_files(str(tmp_path / "g"), mode="error")


def test_pruning_and_skipping(spark, tmp_path, table):
    plan = table.df("cat = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cat" in plan
    t = LakeTable(spark, str(tmp_path / "r")).write(spark.range(1000).repartitionByRange(8, "id"))
    some = t.df(prune=[("id", ">=", 10), ("id", "<", 20)])
    assert some.count() == 10 and len(some.inputFiles()) < len(t.df().inputFiles())
    assert t.df(prune=[("id", ">", 10**6)]).count() == 0


def test_conflict_and_guard(spark, tmp_path):
    seen = []

    class Guarded(LakeTable):
        from contextlib import contextmanager

        @contextmanager
        def commit_guard(self, version):
            seen.append(version)
            yield
    t = Guarded(spark, str(tmp_path / "g")).write(typed(1)).write(typed(2))
    assert seen == [0, 1] and type(t) is Guarded and type(t.at_version(0)) is Guarded
    won, lost = [], []

    def race(i):
        try:
            t.log.publish(2, [L.commit_info("WRITE", {"i": i})])
            won.append(i)
        except FileExistsError:
            lost.append(i)
    threads = [threading.Thread(target=race, args=(i,)) for i in range(8)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(won) == 1 and len(lost) == 7


def test_log_apart_and_history(spark, tmp_path):
    t = LakeTable(spark, str(tmp_path / "data"), str(tmp_path / "elsewhere"))
    t = t.write(typed(1), custom_metadata={"who": "me"}).write(typed(2))
    assert [h["version"] for h in t.history()] == [1, 0] and t.history(False)[0]["who"] == "me"
    assert not (tmp_path / "data/_delta_log").exists() and LakeTable(spark, t.root, str(tmp_path / "elsewhere")).count() == 22


def test_foreign_log(spark, tmp_path):
    """A log of another writer: string partitionBy, adds before removes, unknown actions; and what must be refused."""
    schema = T.StructType().add("a", "double").json()
    add = lambda p, **k: {"add": {"path": p, "partitionValues": {}, "size": 1, "modificationTime": 1, "dataChange": True, "stats": json.dumps({"numRecords": 11}), **k}}
    gone = lambda p: {"remove": {"path": p, "dataChange": True, "deletionTimestamp": 1}}
    log = L.Log(spark, Location.of(spark, str(tmp_path / "_delta_log")))
    info = {"commitInfo": {"timestamp": 1, "operation": "WRITE", "operationParameters": {"mode": "Overwrite", "partitionBy": "[]"}}}
    log.publish(0, [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"id": "x", "schemaString": schema, "partitionColumns": []}}, add("A"), info])
    log.publish(1, [gone("A"), add("A"), add("B"), {"txn": {"appId": "q", "version": 1}}, info])
    log.publish(2, [add("C"), gone("never"), info])
    assert [set(log.snapshot(v).adds) for v in (0, 1, 2)] == [{"A"}, {"B"}, {"B", "C"}]
    L.DRIVER_BYTES, old = 0, L.DRIVER_BYTES
    try:
        assert [set(log.snapshot(v).adds) for v in (0, 1, 2)] == [{"A"}, {"B"}, {"B", "C"}]
    finally:
        L.DRIVER_BYTES = old
    log.publish(3, [add("D", deletionVector={"storageType": "u"}), info])
    with pytest.raises(NotImplementedError):
        log.snapshot()
    log.publish(5, [info])
    with pytest.raises(ValueError):
        log.snapshot()


def test_storage(spark, tmp_path):
    assert normal("/a/b/") == "file:/a/b" and normal("file:///a") == "file:/a" and normal("s3a://b/k/") == "s3a://b/k"
    assert absolute("x/y", "s3a://b/t") == "s3a://b/t/x/y" and absolute("s3a://c/z", "s3a://b") == "s3a://c/z"
    register_settings("s3a://", {"k": "1"})
    register_settings("s3a://b/", {"k": "2"})
    try:
        assert settings_for("s3a://b/x") == {"k": "2"} and settings_for("s3a://c") == {"k": "1"} and settings_for("file:/") == {}
    finally:
        unregister_settings("s3a://")
        unregister_settings("s3a://b/")
    here = Location.of(spark, str(tmp_path / "n"))
    here.mkdir()
    with pytest.raises(FileExistsError):
        here.mkdir(exist_ok=False)
    here.child("b").publish("x")
    here.child("a").publish("y")
    assert [u.rsplit("/", 1)[1] for u, *_ in here.files()] == ["a", "b"] and here.child("a").read_text() == "y"


def test_stream_appends_once(spark, tmp_path):
    from lakeledger.streaming.feed import added_since, append_stream

    spark.range(5).write.parquet(str(tmp_path / "in"))
    t = LakeTable(spark, str(tmp_path / "t")).write(spark.range(100, 103))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for _ in range(2):
        append_stream(stream, t, str(tmp_path / "cp"), "feed").trigger(availableNow=True).start().awaitTermination()
    t = LakeTable(spark, t.root)
    assert t.count() == 8 and added_since(t, 0).count() == 5


def test_predicates_skip_files_and_partitions(spark, tmp_path):
    rows = [(i, "ab"[i % 2], None if i % 50 == 7 else i % 100) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, p string, q int")
    t = LakeTable(spark, str(tmp_path / "t")).write(df.repartitionByRange(5, "id"), partition_by=["p"])
    t = t.write(df.where("id < 100").withColumn("id", F.col("id") + 5000))
    paths = lambda where: len(t.df(where).inputFiles())
    every = len(t.file_urls())
    assert paths("p = 'a'") == every // 2 and paths("id > 4000") == 2 and paths("p = 'b' AND id >= 5000") == 1 and paths("4000 < id AND p = 'zz'") == 0
    assert paths("id > 4000 OR q = 3") == every and paths("rand() < 2") == every
    for where in ("p = 'a' AND id > 4990", "id < 3", "q > 98", "p IS NULL", "id = 5001.0", "upper(p) = 'B' AND q < 5"):
        assert sorted(t.df(where).collect()) == sorted(t.df().where(where).collect()), where


def test_delete_reads_only_what_it_may_concern(spark, tmp_path, monkeypatch):
    from lakeledger.operators import table as module

    rows = [(i, ("a", "b", None)[i % 3], None if i % 10 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, p string, q int")
    whole = LakeTable(spark, str(tmp_path / "t")).write(df, partition_by=["p"])
    read, scan = [], module.scan

    def counted(spark, snapshot, root, adds=None, with_file=False):
        read.append(len(snapshot.adds if adds is None else adds))
        return scan(spark, snapshot, root, adds, with_file)
    for k, (where, null_safe, most) in enumerate([("p = 'a'", True, 0), ("p = 'a'", False, 0), ("p = 'zz'", True, 0), ("p = 'a' AND q > 150", True, 1), ("q > 1000", True, 0),
                                                  ("q > 1000", False, 3), ("p = 'b' AND q > 1000", False, 2)]):
        t = whole.clone(str(tmp_path / f"c{k}"))
        monkeypatch.setattr(module, "scan", counted)
        read.clear()
        after = t.delete(where, null_safe=null_safe)
        monkeypatch.setattr(module, "scan", scan)
        p = f"coalesce({where}, {'false' if null_safe else 'true'})"
        gone = df.where(p).count()
        assert after.df().count() == 300 - gone and after.history()[0]["operationMetrics"]["num_deleted_rows"] == gone, where
        assert max(read or [0]) <= most, (where, read)
    with pytest.raises(ValueError):
        whole.delete("rand() < 0.5")


def test_a_hot_partition_is_written_by_many_tasks(spark, tmp_path):
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        df = spark.range(0, 60_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.when(F.col("id") % 100 < 97, "hot").otherwise("cold").alias("p"))
        t = LakeTable(spark, str(tmp_path / "t")).write(df, partition_by=["p"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    files = [u.rsplit("/", 2)[1] for u in t.file_urls()]
    assert files.count("p=hot") > 4 and files.count("p=cold") <= 2 and t.df().count() == 60_000


def test_settings_stay_with_their_prefix(spark, tmp_path):
    from lakeledger.sources.storage import Location, register_settings, settings_for, unregister_settings

    key = "fs.test.key"
    a, b = str(tmp_path / "a"), str(tmp_path / "ab")
    register_settings(a, {key: "1"})
    try:
        t = LakeTable(spark, b, storage_options={key: "2"}).write(spark.range(3))
        assert settings_for(f"file:{a}/x") == {key: "1"} and settings_for(f"file:{b}/x") == {key: "2"} and settings_for(f"file:{tmp_path}/c") == {}
        assert Location.of(spark, a)._fs().getConf().get(key) == "1" and Location.of(spark, f"{b}/x")._fs().getConf().get(key) == "2"
        assert spark._jsc.hadoopConfiguration().get(key) is None and t.df().count() == 3
    finally:
        unregister_settings(a)
        unregister_settings(b)


def test_schemas_of_many_files_are_all_read(spark, tmp_path):
    for i in range(40):
        pq.write_table(pa.table({"id": [i], **({"late": ["x"]} if i == 39 else {})}), str(tmp_path / f"f{i:02}.parquet"))
    t = LakeTable(spark, str(tmp_path / "t")).import_files([str(tmp_path / f"f{i:02}.parquet") for i in range(40)])
    assert t.schema().names == ["id", "late"] and t.df("late = 'x'").count() == 1


def test_a_union_of_datasets_is_read_file_by_file(spark, tmp_path):
    import pyarrow.dataset as ds

    for n, cols in (("a", {"id": [1, 2]}), ("b", {"id": [3], "x": ["y"]})):
        pq.write_table(pa.table(cols), str(tmp_path / f"{n}.parquet"))
    both = ds.dataset([ds.dataset(str(tmp_path / "a.parquet"), schema=pa.schema([("id", pa.int64())])), ds.dataset(str(tmp_path / "b.parquet"))])
    t = LakeTable(spark, str(tmp_path / "t")).write(both)
    assert sorted(map(tuple, t.df().select("id").collect())) == [(1,), (2,), (3,)]
