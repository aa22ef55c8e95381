"""A snapshot as a lazy DataFrame, shaped so that Catalyst prunes partitions and pushes filters into the Parquet scan."""
from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.intake import NULL_DIR
from ..sources.storage import absolute, file_key, settings_for
from .log import Snapshot
from .prune import excluded, stats_of

MAX_BRANCHES = 64
BROADCAST_BYTES = 32 << 20


def hive_values(path: str) -> list[tuple[str, str | None]]:
    """The (column, value) pairs of a file's folders, from its path as it is on disk."""
    pairs = [p.partition("=") for p in path.split("/")[:-1]]
    return [(unquote(k), None if v == NULL_DIR else unquote(v)) for k, _, v in pairs]


def file_url(add: dict, root: str) -> str:
    """The file's url; paths in the log are url-encoded."""
    return absolute(unquote(add["path"]), root)


def skip(adds: dict, prune) -> dict:
    """The adds whose statistics don't exclude all of ``prune``: (column, operator, value) terms, all of which must hold."""
    return {p: a for p, a in adds.items() if not any(excluded(stats_of(a), t) for t in prune)}


def partition_tuple(add, parts):
    own = add.get("partitionValues") or {}
    return tuple(None if own.get(c) in (None, "") else str(own[c]).lower() if isinstance(own[c], bool) else str(own[c]) for c in parts)


def scan(spark: SparkSession, snapshot: Snapshot, root: str, adds: dict | None = None, with_file: bool = False) -> DataFrame:
    """The rows of ``adds`` (all live files if None) in the snapshot's schema; ``with_file`` adds each row's file as ``_file``."""
    adds = snapshot.adds if adds is None else adds
    schema, parts = snapshot.schema, [c for c in snapshot.partition_columns if c in snapshot.schema.names]
    file = [F.col("_metadata.file_path").alias("_file")] if with_file else []
    cols = [F.col(f"`{f.name}`") for f in schema]
    if not adds:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("_file", F.lit(None).cast("string")) if with_file else empty
    def each(urls, schema, select, **options):
        groups: dict[tuple, list[str]] = {}
        for u in urls:
            groups.setdefault(tuple(sorted(settings_for(u).items())), []).append(u)
        return reduce(DataFrame.unionAll, [select(spark.read.schema(schema).options(**{**dict(k), **options}).parquet(*own)) for k, own in groups.items()])
    whole = lambda df: df.select(*cols, *file)
    if not parts:
        return each([file_url(a, root) for a in adds.values()], schema, whole)
    if all(":" not in a["path"].split("/")[0] and not a["path"].startswith("/")
           and hive_values(unquote(a["path"])) == list(zip(parts, partition_tuple(a, parts))) for a in adds.values()):
        return each([file_url(a, root) for a in adds.values()], schema, whole, basePath=root)
    data = T.StructType([f for f in schema if f.name not in parts])
    tuples: dict[tuple, list[str]] = {}
    for a in adds.values():
        tuples.setdefault(partition_tuple(a, parts), []).append(file_url(a, root))

    def read(paths, select):
        # each file is read for itself, so foreign folders are no partitions
        return each(paths, data, select, recursiveFileLookup="true")
    if len(tuples) <= MAX_BRANCHES:
        branches = []
        for values, paths in tuples.items():
            own = dict(zip(parts, values))
            row = [F.lit(own[f.name]).cast(f.dataType).alias(f.name) if f.name in own else F.col(f"`{f.name}`") for f in schema]
            branches.append(read(paths, lambda df, row=row: df.select(*row, *file)))
        return reduce(DataFrame.unionAll, branches)
    rows = [(file_key(p), *v) for v, paths in tuples.items() for p in paths]
    names = spark.createDataFrame(rows, T.StructType([T.StructField("_p", T.StringType()), *[T.StructField(f"_v{i}", T.StringType()) for i in range(len(parts))]]))
    if sum(len(r[0]) + 32 * len(parts) for r in rows) <= BROADCAST_BYTES:
        names = F.broadcast(names)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    joined = read([p for paths in tuples.values() for p in paths], lambda df: df.select("*", F.col("_metadata.file_path").alias("_file"), path.alias("_q")))
    joined = joined.join(names, F.col("_q") == F.col("_p"))
    return joined.select(*[F.col(f"_v{parts.index(f.name)}").cast(f.dataType).alias(f.name) if f.name in parts else F.col(f"`{f.name}`") for f in schema],
                         *([F.col("_file")] if with_file else []))
