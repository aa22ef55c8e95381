"""Exact deduplication by two-pass Bloom filtering.

Texts are equal when identical after lower-casing A-Z.  A scan turns each text
into its SHA-256 and stores (doc_id, hash) in the shared folder.  Pass one
builds a Bloom filter whose cells count up to two, merged over partitions: a
hash whose cells have all been set twice may be repeated, any other is unique
for certain.  Pass two shuffles only possibly repeated hashes and groups them
exactly; all other rows pass straight through.

The filter is broadcast, so its size is bounded by ``max_bits``: beyond
``max_bits / bits_per_row`` rows the hash space is cut into slices, each with
a filter of its own, which is given up once its slice is tested; the stored
hashes are partitioned by slice.  A hash of ``hot_rows`` rows or more is joined
by a broadcast of the hot groups (at most one in ``hot_rows`` rows), so that no
task holds all rows of a text that a third of the corpus shares.

Defined cases: null text counts as empty; a null doc_id is smaller than every
other, so it stays only where no row of its group has an id; of repeated rows
with one doc_id every row says the same.
"""
from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cleared, maybe_broadcast, stored, with_columns_of

_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
_HASHES = 3
_SEGMENT = 22  # log2 of cells that one merge task holds


def _digest(batches):
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
        digest = [hashlib.sha256(x.as_py().translate(_FOLD)).digest() for x in texts]
        yield pa.record_batch([batch.column("doc_id"), pa.array(digest, pa.binary())], names=["doc_id", "h"])


def _cells(digests: np.ndarray, bits: int) -> np.ndarray:
    """(n, _HASHES) cells of 32-byte digests; the bytes after the slice's."""
    words = digests.reshape(-1, 32).view(np.uint64)[:, 1: 1 + _HASHES]
    return words & np.uint64((1 << bits) - 1)


def _raw(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def _sketch(bits):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _raw(batch.column("h")).reshape(-1, 32)
            kinds, count = np.unique(rows.view("V32").ravel(), return_counts=True)
            cells = np.sort(_cells(np.frombuffer(kinds.tobytes(), np.uint8), bits), axis=1)
            own = np.ones(cells.shape, bool)
            own[:, 1:] = cells[:, 1:] != cells[:, :-1]
            weight = np.repeat(np.minimum(count, 2)[:, None], _HASHES, 1)[own]
            cell, at = np.unique(cells[own], return_inverse=True)
            total = np.bincount(at, weights=weight).astype(np.int64)
            segment = (cell >> np.uint64(_SEGMENT)).astype(np.int64)
            edge = np.append(np.flatnonzero(np.append(True, segment[1:] != segment[:-1])), len(cell))
            low = (cell & np.uint64((1 << _SEGMENT) - 1)).astype(np.uint32)
            for a, b in zip(edge[:-1], edge[1:]):
                yield pa.record_batch([
                    pa.array([int(segment[a])], pa.int64()), pa.array([low[a:b].tobytes()], pa.binary()),
                    pa.array([np.packbits(total[a:b] >= 2).tobytes()], pa.binary())], names=["segment", "cells", "twice"])
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment's partition sketches, streamed: a bit for each cell that was set at least twice."""
    once, twice, segment = np.zeros(1 << _SEGMENT, bool), np.zeros(1 << _SEGMENT, bool), None
    for batch in batches:
        for s, c, t in zip(*(batch.column(x).to_pylist() for x in ("segment", "cells", "twice"))):
            segment = s
            cell = np.frombuffer(c, np.uint32)
            two = np.unpackbits(np.frombuffer(t, np.uint8), count=len(cell)).astype(bool)
            twice[cell] |= two | once[cell]
            once[cell] = True
    yield pa.record_batch([pa.array([segment], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["segment", "bits"])


def _test(shared, bits):
    def run(batches):
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            cells = _cells(_raw(batch.column("h")), bits)
            hit = np.ones(len(cells), bool)
            for j in range(_HASHES):
                c = cells[:, j]
                hit &= (table[c >> np.uint64(3)] >> (np.uint64(7) - (c & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array(hit)], names=["doc_id", "h", "maybe"])
    return run


def repeat_filter(rows: DataFrame, n: int, bits_per_row: int):
    """(the broadcast bit table of cells set at least twice, its size as a power of two) of ``rows`` (doc_id, h)."""
    bits = max(_SEGMENT, int(np.ceil(np.log2(max(n, 1) * bits_per_row))))
    merged = rows.mapInArrow(_sketch(bits), "segment long, cells binary, twice binary").groupBy("segment").applyInArrow(
        _merge, "segment long, bits binary")
    table = bytearray((1 << bits) // 8)
    each = (1 << _SEGMENT) // 8
    for row in merged.toLocalIterator():
        table[row[0] * each:(row[0] + 1) * each] = row[1]
    return rows.sparkSession.sparkContext.broadcast(bytes(table)), bits


def _grouped(maybe: DataFrame, hot_rows: int) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, h) of the rows (doc_id, h)."""
    groups = stored(maybe.groupBy("h").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")
    hot = maybe_broadcast(groups.where(F.col("group_size") >= hot_rows), 80)
    parts = [maybe.join(hot, "h"), maybe.join(hot.select("h"), "h", "left_anti").join(groups.where(F.col("group_size") < hot_rows), "h")]
    return parts[0].union(parts[1].select(*parts[0].columns)).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "h")


@cleared("exact-tested", "exact-groups")
def exact_groups(docs: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 30, hot_rows: int = 100_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    hashed = docs.mapInArrow(_digest, "doc_id long, h binary")
    n = docs.count()
    slices = max(1, -(-n * bits_per_row // max_bits))
    cut = F.pmod(F.conv(F.substring(F.hex("h"), 1, 8), 16, 10).cast("long"), F.lit(slices))
    rows = stored(hashed.withColumn("slice", cut), "exact-hashes", ["slice"] if slices > 1 else None)
    out = None
    for s in range(slices):
        own = rows.where(F.col("slice") == s).select("doc_id", "h")
        shared, bits = repeat_filter(own, -(-n // slices), bits_per_row)
        tested = stored(own.mapInArrow(_test(shared, bits), "doc_id long, h binary, maybe boolean"), "exact-tested")
        shared.destroy()
        alone = tested.where("not maybe").select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "h")
        part = alone.union(_grouped(tested.where("maybe").select("doc_id", "h"), hot_rows))
        out = part if out is None else out.union(part)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("h")).alias("text_sha256"))
