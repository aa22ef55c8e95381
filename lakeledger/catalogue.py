"""The engine's queries for the driver: each builds a throw-away table, works on it and returns rows; with the SQL they must match."""
from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import schema as S
from .operators.table import LakeTable, Mode
from .sources.intake import FileSet, union
from .sources.storage import register_settings, scratch, settings_for, unregister_settings
from pyspark.sql import types as T

#: lineitem is appended in three parts, by this column
_FLAGS = ("A", "N", "R")


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _line(spark, d, i=None):
    df = _read(spark, d, "lineitem")
    return df if i is None else df.where(F.col("l_returnflag") == _FLAGS[i])


def _new(spark, name="table"):
    return LakeTable(spark, scratch(spark, name))


def _thirds(spark, d):
    t = _new(spark)
    for i in range(3):
        t = t.write(_line(spark, d, i))
    return t


def create_scan(spark, d):
    return _new(spark).write(_line(spark, d)).df()


def append_three(spark, d):
    return _thirds(spark, d).df()


def overwrite(spark, d):
    return _new(spark).write(_line(spark, d)).write(_line(spark, d, 0), mode="overwrite").df()


def overwrite_new_schema(spark, d):
    return _new(spark).write(_line(spark, d)).write(_read(spark, d, "nation"), mode="overwrite").df()


def mode_ignore(spark, d):
    return _new(spark).write(_line(spark, d), mode="ignore").write(_line(spark, d), mode="ignore").df()


def mode_error(spark, d):
    t = _new(spark).write(_line(spark, d), mode="error")
    try:
        t.write(_line(spark, d), mode="error")
    except FileExistsError:
        return t.df()
    raise AssertionError("a second write with mode error must fail")


def partitioned_scan(spark, d):
    return _new(spark).write(_line(spark, d), partition_by=["l_returnflag", "l_linestatus"]).df()


def partition_prune_agg(spark, d):
    t = _new(spark).write(_line(spark, d), partition_by=["l_returnflag", "l_linestatus"])
    return t.df("l_returnflag = 'R'").groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


def many_partitions_scan(spark, d):
    return _new(spark).write(_read(spark, d, "documents"), partition_by=["lang", "source"]).df()


def time_travel_v0(spark, d):
    return _thirds(spark, d).at_version(0).df()


def time_travel_v1(spark, d):
    return _thirds(spark, d).at_version(1).df()


def delete_pred(spark, d):
    return _thirds(spark, d).delete("l_returnflag = 'A' OR l_quantity > 45").df()


def delete_all(spark, d):
    return _new(spark).write(_line(spark, d)).delete().df()


def delete_partition_only(spark, d):
    return _new(spark).write(_line(spark, d), partition_by=["l_returnflag"]).delete("l_returnflag = 'A'").df()


_NULLED = "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity > 25 END"


def delete_null_pred(spark, d):
    return _new(spark).write(_line(spark, d)).delete(_NULLED).df()


def delete_null_safe(spark, d):
    return _new(spark).write(_line(spark, d)).delete(_NULLED, null_safe=True).df()


def delete_partition_and_rows(spark, d):
    t = _new(spark).write(_line(spark, d), partition_by=["l_returnflag", "l_linestatus"])
    return t.delete("l_returnflag = 'N' AND l_quantity > 25").df()


def delete_metrics(spark, d):
    m = _new(spark).write(_line(spark, d)).delete("l_quantity > 45").history()[0]["operationMetrics"]
    return spark.createDataFrame([(m["num_copied_rows"], m["num_deleted_rows"])], "copied long, deleted long")


def restore(spark, d):
    return _thirds(spark, d).restore(0).df()


def restore_after_delete(spark, d):
    return _thirds(spark, d).delete("l_quantity > 10").restore(2).df()


def clone(spark, d):
    return _thirds(spark, d).clone(scratch(spark, "clone")).df()


def clone_then_write(spark, d):
    t = _new(spark).write(_line(spark, d))
    return t.clone(scratch(spark, "clone")).write(_line(spark, d)).df()


def clone_version(spark, d):
    return _thirds(spark, d).at_version(1).clone(scratch(spark, "clone")).df()


def schema_merge(spark, d):
    o = _read(spark, d, "orders")
    return _new(spark).write(o.drop("o_orderpriority")).write(o.drop("o_orderstatus"), schema_mode="merge").df()


def union_common(spark, d):
    o = _read(spark, d, "orders")
    return union(spark, [o.drop("o_orderstatus"), o.drop("o_orderpriority")])


def union_merge(spark, d):
    o = _read(spark, d, "orders")
    return union(spark, [o.drop("o_orderpriority"), o.drop("o_orderstatus")], "merge")


def write_paths(spark, d):
    return _new(spark).write([f"{d}/nation.parquet", f"{d}/nation.parquet"]).df()


def write_arrow(spark, d):
    return _new(spark).write(_read(spark, d, "nation").toArrow()).df()


def write_pandas_list(spark, d):
    p = _read(spark, d, "nation").toPandas()
    return _new(spark).write(x for x in (p, p)).df()


def import_files(spark, d):
    return _new(spark).import_files(f"{d}/part.parquet").df()


def _foreign(spark, d, layout):
    root = scratch(spark, "foreign")
    o = _read(spark, d, "orders")
    for (s,) in sorted(o.select("o_orderstatus").distinct().collect()):
        own = o.where(F.col("o_orderstatus") == s).drop("o_orderstatus")
        if layout == "filename":
            own.write.parquet(stage := scratch(spark, "stage"))
            from .sources.storage import Location

            files = [f[0] for f in Location.of(spark, stage).files() if f[0].endswith(".parquet")]
            for i, file in enumerate(files):
                Location(spark, file).rename(Location.of(spark, root).child(f"{s}_part-{i}.parquet"))
        else:
            own.write.parquet(f"{root}/{'o_orderstatus=' if layout == 'hive' else ''}{s}")
    return FileSet(root, layout, T.StructType([T.StructField("o_orderstatus", T.StringType())]))


def _imported(layout):
    def query(spark, d):
        return _new(spark).import_files(_foreign(spark, d, layout), partition_by=["o_orderstatus"]).df()
    return query


def import_three_layouts(spark, d):
    sets = [_foreign(spark, d, x) for x in ("hive", "directory", "filename")]
    return _new(spark).import_files(sets, partition_by=["o_orderstatus"]).df("o_orderstatus = 'F'")


def log_history(spark, d):
    t = _thirds(spark, d).delete("l_quantity > 45").restore(0)
    return spark.createDataFrame([(h["version"], h["operation"]) for h in t.history()], "version long, operation string")


def live_file_stats(spark, d):
    s = F.from_json("stats", "numRecords long, minValues struct<o_orderkey:long>, maxValues struct<o_orderkey:long>, nullCount struct<o_orderkey:long>")
    f = _new(spark).write(_read(spark, d, "orders")).files().select(s.alias("s"))
    return f.agg(F.sum("s.numRecords").alias("n"), F.min("s.minValues.o_orderkey").alias("low"), F.max("s.maxValues.o_orderkey").alias("high"), F.sum("s.nullCount.o_orderkey").alias("nulls"))


def stats_skip_count(spark, d):
    t = _new(spark).write(_read(spark, d, "orders").repartitionByRange(8, "o_orderkey"))
    return t.df(prune=[("o_orderkey", ">=", 100), ("o_orderkey", "<", 900)])


def predicate_skip(spark, d):
    t = _new(spark).write(_read(spark, d, "orders").repartitionByRange(8, "o_orderkey"))
    return t.df("o_orderkey >= 100 AND o_orderkey < 900 AND o_orderstatus <> 'F'")


def metadata_count(spark, d):
    return spark.createDataFrame([(_thirds(spark, d).count(),)], "n long")


def remote_log(spark, d):
    return LakeTable(spark, scratch(spark), scratch(spark, "log")).write(_line(spark, d)).df()


def array_roundtrip(spark, d):
    t = _new(spark).write(_read(spark, d, "embeddings"))
    return t.df().select("vec_id", "label", F.posexplode("embedding").alias("at", "value")).withColumn("value", F.col("value").cast("double"))


def ntz_roundtrip(spark, d):
    return _new(spark).write(_read(spark, d, "events")).df()


def custom_metadata(spark, d):
    t = _new(spark).write(_read(spark, d, "region"), custom_metadata={"job": "nightly"})
    return spark.createDataFrame([(t.history()[0]["job"],)], "job string")


def added_since(spark, d):
    from .streaming.feed import added_since as since

    return since(_thirds(spark, d), 0)


def scan_to_arrow(spark, d):
    return spark.createDataFrame(_new(spark).write(_read(spark, d, "customer")).to_arrow())


def scan_to_pandas(spark, d):
    return spark.createDataFrame(_new(spark).write(_read(spark, d, "customer")).to_pandas())


def file_urls(spark, d):
    return spark.read.parquet(*_thirds(spark, d).file_urls())


def write_arrow_dataset(spark, d):
    import pyarrow.dataset as ds

    return _new(spark).write([ds.dataset(f"{d}/supplier.parquet"), ds.dataset(_read(spark, d, "supplier").toArrow())]).df()


def mode_enum(spark, d):
    t = _new(spark).write(_line(spark, d), mode=Mode.append).write(_line(spark, d), mode=Mode.of("append"))
    return t.write(_line(spark, d), mode=Mode.overwrite).write(_line(spark, d), mode=Mode.ignore).df()


def overwrite_merge(spark, d):
    o = _read(spark, d, "orders")
    return _new(spark).write(o.drop("o_orderpriority")).write(o.drop("o_orderstatus"), mode="overwrite", schema_mode="merge").df()


def commit_conflict(spark, d):
    """Of two writers from one version the second fails, and its rows aren't there."""
    t = _new(spark).write(_read(spark, d, "customer"))
    t.write(_read(spark, d, "customer"))
    try:
        t.write(_read(spark, d, "customer"))
    except FileExistsError:
        return LakeTable(spark, t.root).df()
    raise AssertionError("the second writer of a version must fail")


class _Guarded(LakeTable):
    held: list = []

    @contextmanager
    def commit_guard(self, version):
        self.held.append(version)
        yield


def commit_guard(spark, d):
    _Guarded.held = []
    t = _Guarded(spark, scratch(spark)).write(_read(spark, d, "nation")).write(_read(spark, d, "nation")).delete("n_regionkey = 1").restore(0)
    return spark.createDataFrame([(v, type(t).__name__) for v in _Guarded.held], "version long, kind string")


def versions(spark, d):
    t = _thirds(spark, d).delete("l_quantity > 45")
    return spark.createDataFrame([(v, t.version(), t.at_version(1).version()) for v in t.versions()], "version long, newest long, pinned long")


def replay_at_each_version(spark, d):
    """The live rows at every version, by the files' statistics."""
    t = _thirds(spark, d).delete("l_returnflag = 'N' OR l_quantity > 45").restore(1).write(_line(spark, d), mode="overwrite")
    return spark.createDataFrame([(v, t.at_version(v).count()) for v in t.versions()], "version long, n long")


def log_actions_by_kind(spark, d):
    t = _new(spark)
    for i in range(3):
        t = t.write(_line(spark, d, i), one_file=True)
    log = t.delete("l_returnflag = 'N'").write(_line(spark, d), mode="overwrite", one_file=True).log
    kinds = [log.of_kind(k).select("version", F.lit(k).alias("kind")) for k in ("add", "remove", "metaData", "protocol", "commitInfo")]
    return reduce(DataFrame.union, kinds).groupBy("version", "kind").agg(F.count("*").alias("n"))


def storage_settings(spark, d):
    """A table and its log below prefixes with settings of their own, and which settings hold where."""
    root, log = scratch(spark), scratch(spark, "log")
    register_settings("file://", {"io.file.buffer.size": 8192})
    register_settings(log, {"io.file.buffer.size": 16384})
    try:
        t = LakeTable(spark, root, log, storage_options={"io.file.buffer.size": 4096}).write(_line(spark, d)).delete("l_quantity > 45")
        rows = [(name, settings_for(url).get("io.file.buffer.size")) for name, url in (("table", f"{root}/x"), ("log", f"{log}/x"), ("other", "file:/elsewhere"), ("far", "s3a://x/y"))]
        return t.df().groupBy().agg(F.count("*").alias("n")).crossJoin(spark.createDataFrame(rows, "place string, size string"))
    finally:
        for prefix in ("file://", log, root):
            unregister_settings(prefix)


_ALL = "SELECT * FROM lineitem"
_O = "o_orderkey, o_custkey, o_totalprice, o_orderdate"
_THREE = [(create_scan, _ALL), (append_three, _ALL), (overwrite, f"{_ALL} WHERE l_returnflag = 'A'"), (overwrite_new_schema, "SELECT * FROM nation"),
          (mode_ignore, _ALL), (mode_error, _ALL), (partitioned_scan, _ALL),
          (partition_prune_agg, "SELECT l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"),
          (many_partitions_scan, "SELECT * FROM documents"),
          (time_travel_v0, f"{_ALL} WHERE l_returnflag = 'A'"), (time_travel_v1, f"{_ALL} WHERE l_returnflag <> 'R'"),
          (delete_pred, f"{_ALL} WHERE NOT (l_returnflag = 'A' OR l_quantity > 45)"), (delete_all, f"{_ALL} WHERE false"),
          (delete_partition_only, f"{_ALL} WHERE l_returnflag <> 'A'"), (delete_null_pred, f"{_ALL} WHERE NOT ({_NULLED})"),
          (delete_null_safe, f"{_ALL} WHERE NOT coalesce({_NULLED}, false)"),
          (delete_metrics, "SELECT count(*) FILTER (l_quantity <= 45) AS copied, count(*) FILTER (l_quantity > 45) AS deleted FROM lineitem"),
          (restore, f"{_ALL} WHERE l_returnflag = 'A'"), (restore_after_delete, _ALL), (clone, _ALL), (clone_then_write, f"{_ALL} UNION ALL {_ALL}"),
          (clone_version, f"{_ALL} WHERE l_returnflag <> 'R'"),
          (delete_partition_and_rows, f"{_ALL} WHERE NOT (l_returnflag = 'N' AND l_quantity > 25)"),
          (schema_merge, f"SELECT {_O}, o_orderstatus, NULL AS o_orderpriority FROM orders UNION ALL SELECT {_O}, NULL, o_orderpriority FROM orders"),
          (union_common, f"SELECT {_O} FROM orders UNION ALL SELECT {_O} FROM orders"),
          (union_merge, f"SELECT {_O}, o_orderstatus, NULL AS o_orderpriority FROM orders UNION ALL SELECT {_O}, NULL, o_orderpriority FROM orders"),
          (write_paths, "SELECT * FROM nation UNION ALL SELECT * FROM nation"), (write_arrow, "SELECT * FROM nation"),
          (write_pandas_list, "SELECT * FROM nation UNION ALL SELECT * FROM nation"), (import_files, "SELECT * FROM part"),
          (import_three_layouts, "SELECT orders.* FROM orders, range(3) WHERE o_orderstatus = 'F'"),
          (log_history, "SELECT * FROM (VALUES (0, 'CREATE TABLE'), (1, 'WRITE'), (2, 'WRITE'), (3, 'DELETE'), (4, 'RESTORE')) v(version, operation)"),
          (live_file_stats, "SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, (count(*) - count(o_orderkey))::BIGINT AS nulls FROM orders"),
          (stats_skip_count, "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900"),
          (predicate_skip, "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900 AND o_orderstatus <> 'F'"),
          (metadata_count, "SELECT count(*) AS n FROM lineitem"), (remote_log, _ALL),
          (array_roundtrip, "SELECT vec_id, label, (unnest(range(1, len(embedding) + 1)) - 1)::INT AS at, unnest(embedding)::DOUBLE AS value FROM embeddings"),
          (ntz_roundtrip, "SELECT * FROM events"), (custom_metadata, "SELECT 'nightly' AS job"), (added_since, f"{_ALL} WHERE l_returnflag <> 'A'"),
          (scan_to_arrow, "SELECT * FROM customer"), (scan_to_pandas, "SELECT * FROM customer"), (file_urls, _ALL),
          (write_arrow_dataset, "SELECT * FROM supplier UNION ALL SELECT * FROM supplier"), (mode_enum, _ALL),
          (overwrite_merge, f"SELECT {_O}, o_orderpriority FROM orders"), (commit_conflict, "SELECT * FROM customer UNION ALL SELECT * FROM customer"),
          (commit_guard, "SELECT range AS version, '_Guarded' AS kind FROM range(4)"), (versions, "SELECT range AS version, 3::BIGINT AS newest, 1::BIGINT AS pinned FROM range(4)"),
          (replay_at_each_version, """
SELECT * FROM (SELECT 0::BIGINT AS version, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem UNION ALL SELECT 1, count(*) FILTER (l_returnflag <> 'R') FROM lineitem
UNION ALL SELECT 2, count(*) FROM lineitem UNION ALL SELECT 3, count(*) FILTER (NOT (l_returnflag = 'N' OR l_quantity > 45)) FROM lineitem
UNION ALL SELECT 4, count(*) FILTER (l_returnflag <> 'R') FROM lineitem UNION ALL SELECT 5, count(*) FROM lineitem)"""),
          (log_actions_by_kind, """
SELECT * FROM (VALUES (0::BIGINT, 'add', 1::BIGINT), (1, 'add', 1), (2, 'add', 1), (3, 'remove', 1), (4, 'add', 1), (4, 'remove', 2), (0, 'metaData', 1), (0, 'protocol', 1),
(0, 'commitInfo', 1), (1, 'commitInfo', 1), (2, 'commitInfo', 1), (3, 'commitInfo', 1), (4, 'commitInfo', 1)) v(version, kind, n)"""),
          (storage_settings, """
SELECT n, place, size FROM (SELECT count(*) AS n FROM lineitem WHERE l_quantity <= 45), (VALUES ('table', '4096'), ('log', '4096'), ('other', '8192'), ('far', NULL)) v(place, size)""")]

QUERIES = {f.__name__: f for f, _ in _THREE} | {f"import_{x}": _imported(x) for x in ("hive", "directory", "filename")}
ORACLE_SQL = {f.__name__: q for f, q in _THREE} | {
    f"import_{x}": "SELECT * FROM orders" for x in ("hive", "directory", "filename")}
