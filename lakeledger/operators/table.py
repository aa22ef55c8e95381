"""The table: immutable handles over a data folder and its commit log."""
from __future__ import annotations

import json
from contextlib import contextmanager
from enum import Enum
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import schema as S
from ..plans.log import Log, Snapshot, commit_info, metadata, protocol, removal
from ..plans.prune import conjuncts, split
from ..plans.prune import stats_of as stats_in
from ..plans.scan import file_url, partition_tuple, scan, skip
from ..sources import intake
from ..sources.storage import Location, absolute, file_key, register_settings, scanned_key
from .stage import add_action, schema_of, stats_of, write_files


class Mode(Enum):
    append = "Append"
    overwrite = "Overwrite"
    error = "ErrorIfExists"
    ignore = "Ignore"

    @classmethod
    def of(cls, mode) -> "Mode":
        try:
            return mode if isinstance(mode, cls) else cls[mode]
        except KeyError:
            raise ValueError(f"unknown mode {mode!r}") from None


class LakeTable:
    """A table at one version. Every operation that commits returns a new handle of the same class.

    ``log``: where the commit log lies, if not in ``_delta_log`` below the table.
    ``storage_options``: Hadoop settings for the table's and the log's locations, and for no others.
    """

    def __init__(self, spark: SparkSession, location, log=None, version: int | None = None, storage_options: dict | None = None):
        self.spark = spark
        self.root = Location.of(spark, location)
        if storage_options:
            register_settings(self.root.url, storage_options)
            if log is not None and not isinstance(log, Log):
                register_settings(Location.of(spark, log).url, storage_options)
        self.log = log if isinstance(log, Log) else Log(spark, Location.of(spark, log) if log else self.root.child("_delta_log"))
        self._snapshot = self.log.snapshot(version)

    # -- reading

    @property
    def snapshot(self) -> Snapshot:
        if self._snapshot is None:
            raise ValueError(f"there is no table at {self.root.url}")
        return self._snapshot

    def exists(self) -> bool:
        return self._snapshot is not None

    def version(self) -> int:
        return self.snapshot.version

    def versions(self) -> list[int]:
        return [v for v in self.log.versions() if v <= self.version()]

    def schema(self) -> T.StructType:
        return self.snapshot.schema

    def partition_columns(self) -> list[str]:
        return self.snapshot.partition_columns

    def at_version(self, version: int) -> "LakeTable":
        return type(self)(self.spark, self.root, self.log, version)

    def history(self, newest_first: bool = True) -> list[dict]:
        rows = [{"version": v, **info} for v, info in self.snapshot.history]
        return sorted(rows, key=lambda r: r["version"], reverse=newest_first)

    def file_urls(self) -> list[str]:
        return [file_url(a, self.root.url) for a in self.snapshot.adds.values()]

    def files(self) -> DataFrame:
        """(path, size, partition_values, stats) of the live files."""
        rows = [(file_url(a, self.root.url), a.get("size"), {k: None if v is None else str(v) for k, v in (a.get("partitionValues") or {}).items()}, a.get("stats"))
                for a in self.snapshot.adds.values()]
        return self.spark.createDataFrame(rows, "path string, size long, partition_values map<string,string>, stats string")

    def df(self, where: Column | str | None = None, prune=()) -> DataFrame:
        """The rows, lazily. Files whose partition or statistics exclude a conjunct of ``where`` aren't listed.

        ``prune``: further (column, operator, value) terms that all must hold.
        """
        adds = skip(self.snapshot.adds, prune) if prune else self.snapshot.adds
        if where is not None and adds:
            adds = self._concerned(adds, where)[0]
        out = scan(self.spark, self.snapshot, self.root.url, adds)
        for c, op, v in prune:
            out = out.where({"=": F.col(c) == v, ">": F.col(c) > v, ">=": F.col(c) >= v, "<": F.col(c) < v, "<=": F.col(c) <= v}[op])
        return out if where is None else out.where(where)

    def _concerned(self, adds: dict, where, nulls_count: bool = False):
        """``prune.split`` of the adds by the conjuncts of ``where``; all of them where it isn't deterministic."""
        empty = self.spark.createDataFrame([], self.schema())
        try:
            found = conjuncts(empty, where)
        except ValueError:
            if nulls_count:
                raise
            return adds, {}
        parts = [c for c in self.partition_columns() if c in self.schema().names]
        return split(self.spark, self.schema(), parts, adds, found, lambda a: partition_tuple(a, parts), nulls_count)

    def to_arrow(self):
        return self.df().toArrow()

    def to_pandas(self):
        return self.df().toPandas()

    def count(self) -> int:
        """Rows by the files' statistics, without reading them; by a scan where a file has none."""
        stats = [json.loads(a["stats"]) if a.get("stats") else {} for a in self.snapshot.adds.values()]
        return sum(s["numRecords"] for s in stats) if all("numRecords" in s for s in stats) else self.df().count()

    # -- writing

    def write(self, data, mode="append", schema_mode: str = "strict", partition_by=None, options: dict | None = None, custom_metadata: dict | None = None, one_file: bool = False) -> "LakeTable":
        """Commits ``data`` (anything that ``intake.union`` takes). ``schema_mode`` merge widens the schema by new columns
        when appending; an overwrite takes the schema of its data. ``one_file``: a single data file, or one a partition,
        joined from what all tasks write."""
        mode = Mode.of(mode)
        if self.exists() and mode is Mode.ignore:
            return self
        parts = self._gate(mode, partition_by)
        df = intake.union(self.spark, data, "merge" if schema_mode == "merge" else "common")
        schema = self._evolved(df.schema, mode, schema_mode)
        self._known(parts, schema)
        adds = self._write_files(df, parts, options, **({"one_file": True} if one_file else {}))
        return self._enter(adds, mode, schema, parts, custom_metadata)

    def import_files(self, refs, mode="append", schema_mode: str = "strict", partition_by=None, custom_metadata: dict | None = None) -> "LakeTable":
        """Commits existing Parquet files by their absolute paths, without copying. ``refs``: paths, folders, ``FileSet``s or lists of them."""
        mode = Mode.of(mode)
        if self.exists() and mode is Mode.ignore:
            return self
        parts = self._gate(mode, partition_by)
        files = intake.listed(self.spark, refs)
        if not files:
            raise ValueError("no files to import")
        found = schema_of(self.spark, [f[0] for f in files])
        kinds = {f.name: f for r in (refs if isinstance(refs, (list, tuple)) else [refs]) if isinstance(r, intake.FileSet) and r.partitions for f in r.partitions}
        own = {f.name: f for f in self.schema()} if self.exists() else {}
        fields = list(found)
        for c in parts:
            if c not in found.names:
                fields.append(kinds.get(c) or own.get(c) or T.StructField(c, T.StringType()))
        schema = self._evolved(T.StructType(fields), mode, schema_mode)
        self._known(parts, schema)
        stats = stats_of(self.spark, [f[0] for f in files])
        adds = [add_action(self._quoted(u), v, size, at, stats[u]) for u, size, at, v in files]
        return self._enter(adds, mode, schema, parts, custom_metadata)

    @staticmethod
    def _quoted(url: str) -> str:
        return quote(url, safe="/:=-._~ ")

    def _gate(self, mode: Mode, partition_by) -> list[str]:
        if not self.exists():
            return list(partition_by or [])
        if mode is Mode.error:
            raise FileExistsError(self.root.url)
        have = self.partition_columns()
        if partition_by is not None and set(partition_by) != set(have):
            raise ValueError(f"the table is partitioned by {have}, not {list(partition_by)}")
        return have

    @staticmethod
    def _known(parts, schema):
        missing = set(parts) - set(schema.names)
        if missing:
            raise ValueError(f"partition columns {sorted(missing)} are no columns")

    def _evolved(self, new: T.StructType, mode: Mode, schema_mode: str) -> T.StructType:
        new = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in new])
        if not self.exists():
            return new
        if schema_mode == "merge" and mode is Mode.append:
            return S.merge(self.schema(), new)
        if mode is Mode.append:
            if not S.same(self.schema(), new):
                raise ValueError("Schema mismatch")
            return self.schema()
        return self.schema() if S.same(self.schema(), new) else new

    def _write_files(self, df: DataFrame, partition_by, options, one_file: bool = False) -> list[dict]:
        """Override point: where and how data files are written."""
        return write_files(df, self.root, self._next(), partition_by, options, one_file)

    def _next(self) -> int:
        return self.version() + 1 if self.exists() else 0

    def _enter(self, adds, mode, schema, parts, custom) -> "LakeTable":
        how = {"partitionBy": parts}
        if not self.exists():
            info = commit_info("CREATE TABLE", {"mode": Mode.error.value, "location": self.root.url, **how}, extra=custom)
            return self.commit([protocol(schema), metadata(schema, parts), *adds, info])
        old = list(self.snapshot.adds.values()) if mode is Mode.overwrite else []
        head = [] if schema == self.schema() else self._new_schema(schema, parts)
        info = commit_info("WRITE", {"mode": mode.value, **how}, {"num_added_files": len(adds), "num_removed_files": len(old)}, custom, readVersion=self.version())
        return self.commit([*head, *map(removal, old), *adds, info])

    def _new_schema(self, schema, parts):
        rules = protocol(schema)
        return ([rules] if rules["protocol"]["minReaderVersion"] > self.snapshot.rules.get("minReaderVersion", 1) else []) + [metadata(schema, parts, self.snapshot.meta)]

    # -- changing

    def delete(self, where: Column | str | None = None, null_safe: bool = False, options: dict | None = None, custom_metadata: dict | None = None) -> "LakeTable":
        """Deletes the rows for which ``where`` holds or is null (``null_safe``: only where it holds); all rows without it.

        Files that the partition values or statistics show to have no such row aren't read, and files decided by
        their partition alone go without being read.  Of the others, one scan finds and counts those touched, the
        second copies what stays.  A predicate that isn't deterministic raises ValueError.
        """
        adds = self.snapshot.adds
        if where is None:
            stats = self.count()
            metrics = {"num_added_files": 0, "num_removed_files": len(adds), "num_copied_rows": 0, "num_deleted_rows": stats}
            info = commit_info("DELETE", {"predicate": "true"}, metrics, custom_metadata, readVersion=self.version())
            return self.commit([*map(removal, adds.values()), info])
        p = F.expr(where) if isinstance(where, str) else where
        keep = F.coalesce(~F.coalesce(p, F.lit(False)) if null_safe else ~p, F.lit(False))
        may, whole = self._concerned(adds, p, not null_safe)
        touched = {}
        for path in whole:
            if "numRecords" in (stats := stats_in(adds[path])):
                touched[path] = (may.pop(path), stats["numRecords"], 0)
        by_url = {file_key(file_url(a, self.root.url)): a for a in may.values()}
        seen = scan(self.spark, self.snapshot, self.root.url, may, with_file=True).withColumn("_keep", keep)
        counts = seen.groupBy("_file").agg(F.count("*").alias("n"), F.count_if("_keep").alias("kept")).where("kept < n").collect() if may else []
        touched |= {(a := by_url[scanned_key(r["_file"])])["path"]: (a, r["n"], r["kept"]) for r in counts}
        rewrite = {p: a for p, (a, _, kept) in touched.items() if kept}
        new = self._write_files(scan(self.spark, self.snapshot, self.root.url, rewrite).where(keep), self.partition_columns(), options) if rewrite else []
        copied = sum(k for _, _, k in touched.values())
        metrics = {"num_added_files": len(new), "num_removed_files": len(touched), "num_copied_rows": copied, "num_deleted_rows": sum(n for _, n, _ in touched.values()) - copied}
        text = where if isinstance(where, str) else str(where)
        info = commit_info("DELETE", {"predicate": text}, metrics, custom_metadata, readVersion=self.version())
        return self.commit([*[removal(a) for a, _, _ in touched.values()], *new, info])

    def restore(self, version: int, custom_metadata: dict | None = None) -> "LakeTable":
        """A new commit that makes the table what it was at ``version``."""
        then = self.at_version(version).snapshot
        here = self.snapshot.adds
        back = [{"add": {**a, "dataChange": True}} for p, a in then.adds.items() if p not in here]
        gone = [removal(a) for p, a in here.items() if p not in then.adds]
        metrics = {"num_restored_files": len(back), "num_removed_files": len(gone)}
        info = commit_info("RESTORE", {"version": version}, metrics, custom_metadata, readVersion=self.version())
        return self.commit([{"metaData": then.meta}, *gone, *back, info])

    def clone(self, location, log=None) -> "LakeTable":
        """A shallow copy with the whole history up to this version; its log names the data files by absolute urls."""
        root = Location.of(self.spark, location)
        dest = Log(self.spark, Location.of(self.spark, log) if log else root.child("_delta_log"))
        if dest.files():
            raise FileExistsError(dest.location.url)
        for version, actions in self.log.entries(self.version()):
            for a in actions:
                for kind in ("add", "remove"):
                    if kind in a:
                        a[kind]["path"] = self._quoted(absolute(a[kind]["path"], self.root.url)) if "%" not in a[kind]["path"] else absolute(a[kind]["path"], self.root.url)
            dest.publish(version, actions)
        return type(self)(self.spark, root, dest)

    # -- committing

    @contextmanager
    def commit_guard(self, version: int):
        """Override point: held while a version is published, e.g. a lock for stores without put-if-absent."""
        yield

    def commit(self, actions: list[dict]) -> "LakeTable":
        """Publishes the next version, or raises FileExistsError if another writer was first."""
        version = self._next()
        with self.commit_guard(version):
            self.log.publish(version, actions)
        return type(self)(self.spark, self.root, self.log)
