"""Any supported input as one DataFrame, and foreign partitioned file sets."""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import schema as S
from .storage import Location, normal

NULL_DIR = "__HIVE_DEFAULT_PARTITION__"


def frames(spark: SparkSession, data) -> list[DataFrame]:
    """A DataFrame for each part of ``data``: DataFrames, Arrow tables, batches and datasets, pandas, paths, or iterables of these."""
    if isinstance(data, DataFrame):
        return [data]
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    if isinstance(data, pa.Table):
        table, schema = S.arrow_to_spark(data)
        return [spark.createDataFrame(table, schema)]
    if isinstance(data, pd.DataFrame):
        return frames(spark, pa.Table.from_pandas(data, preserve_index=False))
    if isinstance(data, ds.FileSystemDataset):
        return [spark.read.parquet(*map(normal, data.files))]
    if isinstance(data, ds.UnionDataset):
        # one dataset over its children's fields, each child read where it lies
        return [reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f for c in data.children for f in frames(spark, c)])]
    if isinstance(data, ds.Dataset):
        return frames(spark, data.to_table())
    if isinstance(data, (str, Location)):
        return [spark.read.parquet(Location.of(spark, data).url)]
    if isinstance(data, Iterable):
        return [f for x in data for f in frames(spark, x)]
    raise TypeError(f"can't read a {type(data).__name__}")


def union(spark: SparkSession, data, mode: str = "common") -> DataFrame:
    """UNION ALL of all parts, over their common fields or, with mode ``merge``, all fields."""
    parts = frames(spark, data)
    if not parts:
        raise ValueError("no input")
    if mode not in ("common", "merge"):
        raise ValueError(f"unknown mode {mode}")
    if len(parts) == 1:
        return parts[0]
    schemas = [p.schema for p in parts]
    if mode == "merge":
        S.merge(*schemas)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    keep = [F.col(f"`{f.name}`") for f in S.common(*schemas)]
    return reduce(DataFrame.unionByName, [p.select(*keep) for p in parts])


@dataclass(frozen=True)
class FileSet:
    """Parquet files to import by reference. ``layout``: hive (k=v folders), directory (values only) or filename (v_v_name)."""

    root: str
    layout: str = "hive"
    partitions: T.StructType | None = None

    def values(self, relative: str) -> dict[str, str | None]:
        *folders, name = relative.split("/")
        names = [f.name for f in self.partitions] if self.partitions else []
        if self.layout == "hive":
            pairs = [p.split("=", 1) for p in folders if "=" in p]
        elif self.layout == "directory":
            pairs = list(zip(names, folders))
        elif self.layout == "filename":
            pairs = list(zip(names, name.split("_")))
        else:
            raise ValueError(f"unknown layout {self.layout}")
        return {unquote(k): None if v == NULL_DIR else unquote(v) for k, v in pairs}


def listed(spark: SparkSession, refs) -> list[tuple[str, int, int, dict]]:
    """(url, size, modified, partition values) of the files that ``refs`` names: paths, FileSets or lists of them."""
    if isinstance(refs, (str, Location, FileSet)):
        refs = [refs]
    if not isinstance(refs, Iterable) or isinstance(refs, (pa.Table, pa.RecordBatch, pd.DataFrame, DataFrame)):
        raise TypeError("only files can be imported by reference")
    out = []
    for ref in refs:
        if isinstance(ref, (pa.Table, pa.RecordBatch, pd.DataFrame, DataFrame)):
            raise TypeError("only files can be imported by reference")
        if isinstance(ref, ds.FileSystemDataset):
            out += listed(spark, ref.files)
            continue
        files = ref if isinstance(ref, FileSet) else FileSet(ref.url if isinstance(ref, Location) else ref)
        root = Location.of(spark, files.root)
        if not root.is_dir():
            out += [(*f, {}) for f in root.parent.files() if f[0] == root.url]
            continue
        for url, size, at in root.files(recursive=True):
            relative = url[len(root.url) + 1:]
            if relative.endswith(".parquet") and not any(p[0] in "._" and "=" not in p for p in relative.split("/")):
                out.append((url, size, at, files.values(relative)))
    return out
