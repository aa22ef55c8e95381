"""Removal of repeated word windows behind a count-min prefilter.

A window is ``k`` consecutive words.  Documents are hashed into *blocks* of
bounded size.  Pass one: each block sends the cells of its windows in each of
the sketch's ``depth`` rows (sorted, so two bytes a cell) to sketch shards; a shard merges the blocks'
sketches and sends back, for each cell of a block, one bit: counted more than
once or not.  A window is estimated repeated if all its cells are: the estimate
never falls below the count, so nothing is lost.  Pass
two: only windows estimated repeated send an exact key (96 bits of hash) with
the block's smallest doc_id; shards group them exactly and answer one bit: a
smaller doc_id exists in another block.  Each key goes out once a block however
often it occurs, so a window held by a third of all rows stays small, and no
sketch is ever broadcast: its width follows the corpus, spread over shards.

Blocks and shards grow with the square root of the corpus once it is large, so
that a message holds 64 windows on average at any size and messages stay a small
share of the windows; at 100 TB a block is some 200 MB of text.  Texts are
shuffled once, to their blocks.

Defined cases: null text has no words; a null doc_id is larger than all others;
rows with one doc_id never count as smaller to each other; a text of fewer than
``k`` words loses nothing.
"""
from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import with_columns_of
from .textops import NONSPACE, cover, hash_words, int_column, mix, slices, split_words, windows

_REPLY = "block int, kind int, shard int, bits binary"


def _pack(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 as deltas of 2 bytes where they fit, else 8."""
    delta = np.diff(values, prepend=values[:1])
    head = (values[:1]).tobytes()
    small = not len(delta) or int(delta.max()) < 65536
    return (b"\x02" if small else b"\x08") + head + (delta.astype(np.uint16) if small else delta).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    kind = np.uint16 if blob[0] == 2 else np.uint64
    delta = np.frombuffer(blob, kind, offset=9).astype(np.uint64)
    return np.cumsum(delta) + np.frombuffer(blob, np.uint64, 1, offset=1)


class _Block:
    """Windows of one block of documents."""

    def __init__(self, table: pa.Table, k: int, second: bool):
        self.k = k
        self.text = table.column("text").combine_chunks()
        self.doc, self.null = int_column(table, "doc_id")
        h1, h2, rows, self.parts = [], [], [], []
        for a, b, buf, offs in slices(self.text):
            starts, ends, first = split_words(buf, offs, NONSPACE)
            h, at, edge = windows(hash_words(buf, starts, ends, False, 0), first, k, 0)
            h1.append(h)
            if second:
                h2.append(windows(hash_words(buf, starts, ends, False, 1), first, k, 1)[0])
            rows.append(np.repeat(np.arange(a, b, dtype=np.int32), np.diff(edge)))
            self.parts.append((a, b, first, at.astype(np.int32)))
        self.h1 = np.concatenate(h1) if h1 else np.zeros(0, np.uint64)
        self.h2 = (np.concatenate(h2) if h2 else np.zeros(0, np.uint64)) if second else None
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int32)

    def cells(self, bits, row):
        """Sorted distinct cells of one row of the sketch, and each window's place among them."""
        h = self.h1 if not row else mix(self.h1 + np.uint64(row * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return np.unique(h >> np.uint64(64 - bits), return_inverse=True)

    def flagged(self, bits, shard_bits, depth, replies):
        """Windows that all rows of the merged sketch estimate repeated."""
        out = np.ones(len(self.h1), bool)
        for row in range(depth):
            cells, at = self.cells(bits, row)
            out &= _bits([(s, b) for s, b in replies if s >> shard_bits == row], len(cells))[at]
        return np.flatnonzero(out)

    def keys(self, some):
        """Distinct exact keys of the windows ``some`` in order, their smallest doc_id, and each window's place."""
        h1, h2, doc = self.h1[some], self.h2[some].astype(np.uint32), self.doc[self.row[some]]
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return h1[at], h2[at], doc[at], place


def _bits(replies, n):
    got = [np.unpackbits(np.frombuffer(b[4:], np.uint8), count=int.from_bytes(b[:4], "little")) for _, b in sorted(replies)]
    out = np.concatenate(got).astype(bool) if got else np.zeros(0, bool)
    if len(out) != n:
        raise RuntimeError(f"replies cover {len(out)} of {n} entries")
    return out


def _reply(mask):
    return len(mask).to_bytes(4, "little") + np.packbits(mask).tobytes()


def _by_shard(top, shard_bits):
    shard = (top >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(top), np.int64)
    edge = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    for a, b in zip(edge, np.append(edge[1:], len(shard))):
        yield int(shard[a]), a, b


def _sketch(k, bits, shard_bits, depth):
    def run(key, table):
        own, out = _Block(table, k, False), []
        for row in range(depth):
            cells, at = own.cells(bits, row)
            twice = np.bincount(at, minlength=len(cells)) >= 2
            out += [(key[0].as_py(), row << shard_bits | s, _pack(cells[a:b]), np.packbits(twice[a:b]).tobytes())
                    for s, a, b in _by_shard(cells << np.uint64(64 - bits), shard_bits)]
        block, shard, blob, two = zip(*out) if out else ([], [], [], [])
        return pa.table([pa.array(block, pa.int32()), pa.array(shard, pa.int32()), pa.array(blob, pa.binary()), pa.array(two, pa.binary())],
                        names=["block", "shard", "cells", "twice"])
    return run


def _merge_sketches(key, table):
    blocks = table.column("block").to_pylist()
    cells = [_unpack(x) for x in table.column("cells").to_pylist()]
    weight = [1 + np.unpackbits(np.frombuffer(t, np.uint8), count=len(c)) for t, c in zip(table.column("twice").to_pylist(), cells)]
    every = np.concatenate(cells)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    total = np.add.reduceat(np.concatenate(weight).astype(np.int64)[order], first)
    repeated = np.empty(len(every), bool)
    repeated[order] = np.repeat(total >= 2, np.diff(np.append(first, len(every))))
    return _replies(blocks, [len(c) for c in cells], repeated, 0, key[0].as_py())


def _replies(blocks, sizes, mask, kind, shard):
    edge = np.cumsum([0, *sizes])
    return pa.table([pa.array(blocks, pa.int32()), pa.array([kind] * len(blocks), pa.int32()), pa.array([shard] * len(blocks), pa.int32()),
                     pa.array([_reply(mask[a:b]) for a, b in zip(edge[:-1], edge[1:])], pa.binary())], names=["block", "kind", "shard", "bits"])


def _exact(k, bits, shard_bits, depth):
    def run(key, docs, replies):
        out = []
        if docs.num_rows:
            block = _Block(docs, k, True)
            h1, h2, doc, _ = block.keys(block.flagged(bits, shard_bits, depth, _of(replies, 0)))
            for s, a, b in _by_shard(h1, shard_bits):
                ids, at = np.unique(doc[a:b], return_inverse=True)
                at = at.astype(np.uint16 if len(ids) < 65536 else np.uint32)
                out.append((key[0].as_py(), s, h1[a:b].tobytes(), h2[a:b].tobytes(), ids.tobytes(), at.tobytes()))
        cols = list(zip(*out)) or [[]] * 6
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                        names=["block", "shard", "h1", "h2", "ids", "at"])
    return run


def _merge_keys(key, table):
    blocks = table.column("block").to_pylist()
    h1 = [np.frombuffer(x, np.uint64) for x in table.column("h1").to_pylist()]
    sizes = [len(x) for x in h1]
    h1 = np.concatenate(h1)
    h2 = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("h2").to_pylist()])
    doc = []
    for ids, at, n in zip(table.column("ids").to_pylist(), table.column("at").to_pylist(), sizes):
        ids = np.frombuffer(ids, np.int64)
        doc.append(ids[np.frombuffer(at, np.uint16 if len(ids) < 65536 else np.uint32)])
    doc = np.concatenate(doc)
    order = np.lexsort((doc, h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    first = np.flatnonzero(new)
    least = np.repeat(doc[order][first], np.diff(np.append(first, len(order))))
    smaller = np.empty(len(order), bool)
    smaller[order] = doc[order] > least
    return _replies(blocks, sizes, smaller, 1, key[0].as_py())


def _of(replies, kind):
    return [(s, b) for q, s, b in zip(replies.column("kind").to_pylist(), replies.column("shard").to_pylist(), replies.column("bits").to_pylist()) if q == kind]


def _remove(k, bits, shard_bits, depth):
    def run(key, docs, replies):
        texts, n_words, n_removed = [], [], []
        if docs.num_rows:
            block = _Block(docs, k, True)
            some = block.flagged(bits, shard_bits, depth, _of(replies, 0))
            h1, _, least, place = block.keys(some)
            gone = np.zeros(len(block.h1), bool)
            gone[some] = _bits(_of(replies, 1), len(h1))[place] | (block.doc[block.row[some]] > least[place])
            raw = pc.fill_null(block.text.cast(pa.large_binary()), b"")
            done = 0
            for a, b, first, at in block.parts:
                own = gone[done:done + len(at)]
                done += len(at)
                removed = cover(int(first[-1]), at[own], k) if own.any() else None
                for r in range(a, b):
                    words = raw[r].as_py().split()
                    n_words.append(len(words))
                    kept = words
                    if removed is not None and (mask := removed[first[r - a]:first[r - a + 1]]).any():
                        kept = list(compress(words, ~mask))
                    n_removed.append(len(words) - len(kept))
                    texts.append(b" ".join(kept))
        return pa.table([docs.column("doc_id") if docs.num_rows else pa.array([], pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                         pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, k: int = 13, block_bytes: int = 8 << 20, cells_per_window: int = 4, depth: int = 2, shard_entries: int = 1 << 21,
                   message_windows: int = 64) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window over it also starts in a document with a smaller doc_id.
    ``block_bytes`` of text in a block task and ``shard_entries`` entries in a merge task are the
    least; both grow until a message from a block to a shard holds ``message_windows`` windows.
    """
    docs = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    guess = max(1, size // 5)  # windows, for the sizes only
    even = int((message_windows * guess) ** 0.5)
    block_bytes, shard_entries = max(block_bytes, 5 * even), max(shard_entries, even)
    blocks = max(1, -(-size // block_bytes))
    bits = max(8, int(np.ceil(np.log2(guess * cells_per_window))))
    shard_bits = min(bits, int(np.ceil(np.log2(max(1, guess / shard_entries)))))
    parts = max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    home = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("long")), F.octet_length("text")), F.lit(blocks)).cast("int")
    rows = docs.withColumn("block", home).repartition(parts, "block")

    sketches = rows.groupBy("block").applyInArrow(_sketch(k, bits, shard_bits, depth), "block int, shard int, cells binary, twice binary")
    repeated = sketches.groupBy("shard").applyInArrow(_merge_sketches, _REPLY)
    by_block = rows.groupBy("block")
    exact = by_block.cogroup(repeated.groupBy("block")).applyInArrow(
        _exact(k, bits, shard_bits, depth), "block int, shard int, h1 binary, h2 binary, ids binary, at binary")
    smaller = exact.groupBy("shard").applyInArrow(_merge_keys, _REPLY)
    return by_block.cogroup(repeated.union(smaller).groupBy("block")).applyInArrow(
        _remove(k, bits, shard_bits, depth), "doc_id long, n_words long, n_removed long, kept_text string")
