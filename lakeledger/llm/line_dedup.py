"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` keeps runs (key, n_docs, last_doc), each a table bucketed and sorted
by key in the shared folder, so that joins with it neither move nor sort it.  A
batch's keys are merge-anti-joined with the runs: those that no run has become a
run of level 0, and those that some run has are noted in a tally.  So the runs
are disjoint, a key that is never seen again is never looked at again, and
``fanout`` runs of one level are compacted into one of the next.

``dedup_batch`` is the incremental use: lines that an earlier batch had go.
``dedup_lines`` is the whole-corpus use: after the last batch the keys of the
runs and the tally that have enough documents are known, and all documents are
read once more to drop them.  The frequent keys are broadcast if their counted
size fits ``broadcast_bytes``; else the lines are joined with them and each
document with its own drops.

A key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased, by 128 bits of blake2b.

Defined cases: a null or empty text is one empty line; a row is a document, so
repeated rows count each; a null doc_id counts as a document but is never the
largest; keys whose documents all lack an id lose nothing.
"""
from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import UNMARKED, Shared, cleared, new_path, return_heap_if_due, small, stored, trimmed, with_columns_of

_STRIP = b" \t\n\x0b\x0c\r"
_KEYED = "doc_id long, row struct<id:long,lacks:boolean,text:long>, key binary"


def line_key(line: bytes, min_len: int):
    """16-byte key of a line of at least ``min_len`` code points, else None."""
    line = line.strip(_STRIP)
    if len(line) < min_len or (len(line) < 4 * min_len and len(line.decode("utf-8", "replace")) < min_len):
        return None
    return hashlib.blake2b(line.lower(), digest_size=16).digest()


def _texts(batch):
    return pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()


def _keys(min_len):
    def run(batches):
        for batch in small(batches):
            at, keys = [], []
            for i, text in enumerate(_texts(batch)):
                own = {line_key(x, min_len) for x in text.split(b"\n")} - {None}
                at += [i] * len(own)
                keys += own
            at = pa.array(at, pa.int64())
            yield pa.record_batch([batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(keys, pa.binary())], names=["doc_id", "row", "key"])
    return trimmed(run)


def _drop(min_len, columns):
    def run(batches):
        for batch in small(batches):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(_texts(batch), batch.column("drop").to_pylist()):
                lines = text.split(b"\n")
                kept = lines
                if drop:
                    drop = set(drop)
                    kept = [x for x in lines if line_key(x, min_len) not in drop]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append((b"\n".join(kept)) if kept is not lines else text)
            yield pa.record_batch(
                [*(batch.column(c) for c in columns), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[*columns, "kept_text", "n_lines", "n_dropped"])
    return trimmed(run)


def _row():
    """A row by its id and its text's hash; rows alike in both lose the same lines."""
    return F.struct(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("id"), F.col("doc_id").isNull().alias("lacks"), F.xxhash64("text").alias("text"))


def line_keys(docs: DataFrame, min_len: int = 40) -> DataFrame:
    """(doc_id, row, key): the distinct keys of each row's lines of at least ``min_len`` code points."""
    rows = with_columns_of(docs, {"doc_id": "long", "text": "string"}).withColumn("row", _row())
    return rows.mapInArrow(_keys(min_len), _KEYED)


class LineRuns:
    """Levelled, disjoint sorted runs and the tally of keys seen again; immutable tables, so a lost task rereads its input."""

    SCHEMA = "key binary, n_docs long, last_doc long"

    def __init__(self, spark: SparkSession, fanout: int = 4, rows: int | None = None, bucket_rows: int = 1 << 18):
        """``rows``: how many keys will come at most, if that is known; runs have no more buckets than those fill with ``bucket_rows``."""
        self.spark, self.fanout, self.runs, self.tally = spark, fanout, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if rows is not None:
            self.buckets = min(self.buckets, max(1, -(-rows // bucket_rows)))

    def _write(self, rows: DataFrame, level: int) -> None:
        path = new_path(self.spark, f"line-run-{level}")
        name = "run_" + path.rsplit("-", 1)[1]
        return_heap_if_due(self.spark)
        rows.repartition(self.buckets, "key").write.format("parquet").options(path=path, **UNMARKED).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        self.runs.append((level, name))

    def add(self, lines: DataFrame) -> DataFrame:
        """A batch's keys go into the runs; (key, n_docs, last_doc) of those that the runs had already."""
        own = stored(lines.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")), "line-batch")
        fresh = self.unseen(own)
        if not self.runs:
            self._write(fresh, 0)
            return own.limit(0)
        self._write(fresh, 0)
        again = stored(own.join(self.spark.table(self.runs[-1][1]).select("key").hint("merge"), "key", "left_anti"), "line-again")
        self.tally.append(again)
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            self.runs = [r for r in self.runs if r[0] != level]
            self._write(reduce(DataFrame.union, [self.spark.table(n) for _, n in full]), level + 1)
            self._forget(full)
            level += 1
        return again

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose key no run has: a merge-anti-join with each run in turn, newest first."""
        for _, name in reversed(self.runs):
            rows = rows.join(self.spark.table(name).select("key").hint("merge"), "key", "left_anti")
        return rows

    def totals(self) -> DataFrame:
        """(key, n_docs, last_doc) of every key over all batches."""
        if not self.runs:
            return self.spark.createDataFrame([], self.SCHEMA)
        every = reduce(DataFrame.union, [self.spark.table(n) for _, n in self.runs])
        if not self.tally:
            return every
        again = reduce(DataFrame.union, self.tally).repartition(self.buckets, "key").groupBy("key").agg(F.sum("n_docs").alias("n"), F.max("last_doc").alias("last"))
        return every.join(again, "key", "left").select(
            "key", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))

    def _forget(self, runs) -> None:
        for _, name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the name only; the files stay for what still reads them

    def close(self) -> None:
        self._forget(self.runs)


def _drop_known(shared, min_len, columns):
    """Lines whose key another document keeps, by a broadcast of the frequent keys, sorted, with the document that keeps each."""
    def run(batches):
        keys, last = shared.value
        keep = dict(zip(keys, last))
        for batch in small(batches):
            texts, n_lines, n_dropped = [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), _texts(batch)):
                lines = text.split(b"\n")
                kept = [x for x in lines if keep.get(line_key(x, min_len), i) == i]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(text if len(kept) == len(lines) else b"\n".join(kept))
            yield pa.record_batch(
                [*(batch.column(c) for c in columns), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[*columns, "kept_text", "n_lines", "n_dropped"])
    return trimmed(run)


def _out_schema(docs: DataFrame) -> tuple[list[str], StructType]:
    others = [c for c in docs.columns if c != "text"]
    return others, StructType([docs.schema[c] for c in others]).add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long")


def _apply(docs: DataFrame, drops: DataFrame, min_len: int) -> DataFrame:
    """``drops``: (row, key).  Rows are told apart by their text's hash as well as by id, so that null ids don't meet in one task."""
    sets = drops.groupBy("row").agg(F.collect_set("key").alias("drop")).withColumnRenamed("row", "_row")
    others, schema = _out_schema(docs)
    joined = docs.withColumn("_own", _row()).join(sets, F.col("_own") == F.col("_row"), "left").select(*others, "text", "drop")
    return joined.mapInArrow(_drop(min_len, others), schema)


def dedup_batch(runs: LineRuns, docs: DataFrame, min_len: int = 40) -> DataFrame:
    """Drops lines that an earlier batch had, then adds this batch's keys to the runs."""
    docs = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    lines = stored(line_keys(docs, min_len), "line-keys")
    repeated = runs.add(lines)
    drops = stored(lines.join(repeated.select("key"), "key"), "line-drops")
    return _apply(docs, drops.select("row", "key"), min_len)


@cleared("line-lasting")
def dedup_lines(docs: DataFrame, min_len: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3, carry: dict | None = None,
                broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, the columns of ``carry`` ({name: type}), kept_text, n_lines, n_dropped.

    Keys found in at least ``min_docs`` documents lose all their lines except in the largest doc_id holding them.
    """
    docs = with_columns_of(docs, {"doc_id": "long", "text": "string", **(carry or {})})
    lines = stored(line_keys(docs, min_len).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")), "line-keys", ["batch"])
    runs = LineRuns(docs.sparkSession, fanout, lines.count())
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select("doc_id", "key"))
    often = stored(runs.totals().where((F.col("n_docs") >= min_docs) & F.col("last_doc").isNotNull()).select("key", "last_doc"), "line-often")
    runs.close()
    if often.count() * 64 <= broadcast_bytes:
        known = often.orderBy("key").toArrow()
        others, schema = _out_schema(docs)
        shared = Shared(docs.sparkSession, (known.column("key").to_pylist(), known.column("last_doc").to_pylist()))
        return docs.select(*others, "text").mapInArrow(_drop_known(shared, min_len, others), schema)
    drops = lines.select("doc_id", "row", "key").join(often, "key").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return _apply(docs, stored(drops.select("row", "key"), "line-lasting"), min_len)
