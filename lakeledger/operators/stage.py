"""Data files: written to a staging folder, moved into place, and described by their footers' statistics."""
from __future__ import annotations

import datetime as dt
import json
import math
import uuid
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import schema as S
from ..plans.scan import hive_values
from ..sources.storage import Location
from .joined import join_files

#: footers of more files than this are read by the executors
DRIVER_FOOTERS = 32


def _plain(v):
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, float) and (math.isnan(v) or math.isinf(v)):
        return None
    return v if isinstance(v, (bool, int, float, str)) else None


def _metadata(url: str):
    fs, path = (pafs.LocalFileSystem(), url[5:]) if url.startswith("file:") else pafs.FileSystem.from_uri(url)
    return pq.read_metadata(path, filesystem=fs)


def footer_schema(url: str) -> str:
    """A Parquet file's schema as Spark's JSON."""
    schema = _metadata(url).schema.to_arrow_schema().remove_metadata()
    return S.arrow_to_spark(schema.empty_table())[1].json()


def footer_stats(url: str) -> str:
    """numRecords, minValues, maxValues and nullCount of a Parquet file; a bound is missing where any row group lacks it."""
    md = _metadata(url)
    low, high, nulls, lacking = {}, {}, {}, set()
    for g in range(md.num_row_groups):
        group = md.row_group(g)
        for c in range(group.num_columns):
            col = group.column(c)
            name = col.path_in_schema
            if "." in name:
                continue
            s = col.statistics
            if s is None or not s.has_null_count:
                nulls[name] = None
            elif nulls.get(name, 0) is not None:
                nulls[name] = nulls.get(name, 0) + s.null_count
            if s is not None and s.has_null_count and s.null_count == group.num_rows:
                continue
            a, b = (_plain(s.min), _plain(s.max)) if s is not None and s.has_min_max else (None, None)
            if a is None or b is None:
                lacking.add(name)
                continue
            low[name] = a if name not in low else min(low[name], a)
            high[name] = b if name not in high else max(high[name], b)
    keep = lambda d: {k: v for k, v in d.items() if k not in lacking}
    return json.dumps({"numRecords": md.num_rows, "minValues": keep(low), "maxValues": keep(high), "nullCount": {k: v for k, v in nulls.items() if v is not None}})


def _footers(spark: SparkSession, urls: list[str], read) -> DataFrame:
    """(url, value) of ``read`` over every file's footer, on the executors."""
    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({"url": pdf["url"], "value": [read(u) for u in pdf["url"]]})
    return spark.createDataFrame([(u,) for u in urls], "url string").repartition(min(len(urls), 1000)).mapInPandas(run, "url string, value string")


def stats_of(spark: SparkSession, urls: list[str]) -> dict[str, str]:
    if len(urls) <= DRIVER_FOOTERS:
        return {u: footer_stats(u) for u in urls}
    return {r["url"]: r["value"] for r in _footers(spark, urls, footer_stats).toLocalIterator()}


def schema_of(spark: SparkSession, urls: list[str]) -> T.StructType:
    """The merged schema of all the files; only distinct ones reach the driver."""
    if len(urls) <= DRIVER_FOOTERS:
        found = {footer_schema(u): u for u in reversed(urls)}
        found = sorted(found, key=found.get)
    else:
        rows = _footers(spark, urls, footer_schema).groupBy("value").agg(F.min("url").alias("url")).orderBy("url").collect()
        found = [r["value"] for r in rows]
    return S.merge(*[S.parse(x) for x in found])


def add_action(path: str, values: dict, size: int, modified: int, stats: str, data_change: bool = True) -> dict:
    return {"add": {"path": path, "partitionValues": values, "size": size, "modificationTime": modified, "dataChange": data_change, "stats": stats}}


def _one_a_folder(spark: SparkSession, staging: Location, files: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The same rows in one file a folder."""
    folders: dict[str, list] = {}
    for f in files:
        folders.setdefault(f[0].rsplit("/", 1)[0], []).append(f)
    made = {own[0][0] for own in folders.values() if len(own) == 1}
    for folder, own in folders.items():
        if len(own) > 1:
            join_files(spark, own, to := Location(spark, folder).child(f"joined-{uuid.uuid4().hex}.parquet"))
            made.add(to.url)
    return [f for f in staging.files(recursive=True) if f[0] in made]


def write_files(df: DataFrame, root: Location, version: int, partition_by, options: dict | None = None, one_file: bool = False) -> list[dict]:
    """Writes ``df`` below ``root`` and returns the files' add actions; existing data is never touched.

    ``one_file``: one file a partition, which as many tasks write as without it.
    """
    spark = df.sparkSession
    parts = list(partition_by)
    staging = root.child(f"_staging-{uuid.uuid4().hex}")
    if parts:
        # one file a partition, not one a task; adaptive execution cuts what is larger than its advisory size
        df = df.hint("rebalance", *[F.col(f"`{c}`") for c in parts])
    writer = df.write.options(**root.settings, **(options or {}))
    (writer.partitionBy(*parts) if parts else writer).parquet(staging.url)
    token, moved = uuid.uuid4().hex, []
    try:
        found = [f for f in staging.files(recursive=True) if f[0].endswith(".parquet") and not f[0].rsplit("/", 1)[1].startswith(".")]
        if one_file:
            found = _one_a_folder(spark, staging, found)
        for i, (url, size, modified) in enumerate(found):
            below = url[len(staging.url) + 1:]
            values = dict(hive_values(below))
            relative = "/".join([*below.split("/")[:-1], f"{version}-{token}-{i}.parquet"])
            Location(spark, url).rename(root.child(*relative.split("/")))
            moved.append((relative, values, size, modified))
    finally:
        staging.remove()
    stats = stats_of(spark, [f"{root.url}/{m[0]}" for m in moved])
    return [add_action(quote(p, safe="/=-._~ "), v, size, at, s) for p, v, size, at in moved
            if json.loads(s := stats[f"{root.url}/{p}"])["numRecords"]]
