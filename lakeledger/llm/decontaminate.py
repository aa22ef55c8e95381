"""Benchmark decontamination by winnowing.

A window is ``k`` consecutive words.  Of the ``gram``-word hashes the minimum
of every run of ``k - gram + 1`` is kept, on both sides, so each shared window
shares at least one kept fingerprint.  Fingerprints that meet are extended to
the full windows around them, compared by 128 bits of hash.

A benchmark of at most ``broadcast_bytes`` of text is indexed whole and broadcast;
then one pass over the documents needs no shuffle.  A larger one becomes a table
of its windows: documents send the windows around fingerprints that a Bloom
filter of bounded size lets through, these are joined with the table by their
128 bits, and hits return to their documents by the text's hash.

Defined cases: null or empty texts have no words; items without words or with
null item_id are ignored; repeated rows are judged alike, rows of one doc_id each
by its own text; an item of fewer than ``k`` words is one window of all its words.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shared, cleared, stored, with_columns_of
from .textops import ALNUM, cover, hash_words, mix, slices, split_words, windows, _MULT

_SPANS = "array<struct<start:long,end:long>>"
OUT = f"doc_id long, n_words long, n_hit long, item_ids array<long>, spans {_SPANS}"
_FILTER_BITS = 22


def _hash_at(words, at, k, which):
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += words[at + j] * _MULT[which][j]
    return mix(h)


def winnow(grams: np.ndarray, edge: np.ndarray, size: int) -> np.ndarray:
    """Indices of grams that are the rightmost minimum of some run of ``size`` grams of one row."""
    n = len(grams) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    least = grams[:n].copy()
    for d in range(1, size):
        np.minimum(least, grams[d: d + n], out=least)
    todo = row[:n] == row[size - 1:]
    keep = np.zeros(len(grams), bool)
    for d in range(size - 1, -1, -1):
        hit = todo & (grams[d: d + n] == least)
        keep[d: d + n] |= hit
        todo &= ~hit
    return np.flatnonzero(keep)


class WindowIndex:
    """Items' windows of one length by 128-bit key, with the items of each."""

    def __init__(self, k, h1, h2, item):
        order = np.lexsort((item, h2, h1))
        h1, h2, item = h1[order], h2[order], item[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.flatnonzero(new)
        self.k, self.h1, self.h2, self.item = k, h1[at], h2[at], item
        self.edge = np.append(at, len(item))
        clash = np.diff(np.flatnonzero(np.append(np.append(True, self.h1[1:] != self.h1[:-1]), True)))
        self.most = int(clash.max()) if len(clash) else 0
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.h1 >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, h1, h2):
        """Index of each key, or -1."""
        out = np.full(len(h1), -1)
        at = np.searchsorted(self.h1, h1)
        for d in range(self.most):
            i = np.minimum(at + d, len(self.h1) - 1)
            out[(self.h1[i] == h1) & (self.h2[i] == h2)] = i[(self.h1[i] == h1) & (self.h2[i] == h2)]
        return out


def item_windows(texts, k, gram):
    """({window length: [(hash, second hash, item index)]}, fingerprints) of benchmark texts."""
    by_len: dict = {}
    prints = []
    for a, b, buf, offs in slices(texts):
        starts, ends, first = split_words(buf, offs, ALNUM)
        w = [hash_words(buf, starts, ends, True, x) for x in (0, 1)]
        for r in range(b - a):
            n = int(first[r + 1] - first[r])
            if not n:
                continue
            size = min(k, n)
            at = np.arange(first[r], first[r + 1] - size + 1)
            by_len.setdefault(size, []).append((_hash_at(w[0], at, size, 0), _hash_at(w[1], at, size, 1), np.full(len(at), a + r)))
        g, _, edge = windows(w[0], first, gram)
        prints.append(g[winnow(g, edge, k - gram + 1)])
    return by_len, prints


def windows_around(w1, first, k, gram, let_through):
    """First words of the ``k``-word windows around the fingerprints that ``let_through`` keeps."""
    run = k - gram + 1
    g, at, edge = windows(w1, first, gram)
    kept = winnow(g, edge, run)
    word = at[kept[let_through(g[kept])]]
    if not len(word):
        return np.zeros(0, np.int64)
    row = np.searchsorted(first, word, "right") - 1
    near = word[:, None] - np.arange(run)[None, :]
    return np.unique(near[(near >= first[row][:, None]) & (near + k <= first[row + 1][:, None])])


class ItemIndex:
    """Fingerprints and windows of a benchmark."""

    def __init__(self, item_ids, texts, k, gram):
        self.k, self.gram = k, gram
        self.ids = np.array(item_ids, np.int64)
        by_len, prints = item_windows(pa.array(texts, pa.string()), k, gram)
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.prints >> np.uint64(64 - _FILTER_BITS)] = True
        self.by_len = {s: WindowIndex(s, *(np.concatenate(x) for x in zip(*v))) for s, v in by_len.items()}

    def _let_through(self, g):
        some = self.bits[g >> np.uint64(64 - _FILTER_BITS)]
        some[some] = np.isin(g[some], self.prints)
        return some

    def hits(self, buf, starts, ends, first):
        """[(window length, first words of occurring windows, index of each in its WindowIndex)]"""
        w1 = hash_words(buf, starts, ends, True, 0)
        w2 = None
        out = []
        for size, index in self.by_len.items():
            if size == self.k:
                at = windows_around(w1, first, size, self.gram, self._let_through)
                h1 = _hash_at(w1, at, size, 0)
            else:
                h1, at, _ = windows(w1, first, size)
                some = np.flatnonzero(index.bits[h1 >> np.uint64(64 - _FILTER_BITS)])
                h1, at = h1[some], at[some]
            if not len(at):
                continue
            if w2 is None:
                w2 = hash_words(buf, starts, ends, True, 1)
            found = index.find(h1, _hash_at(w2, at, size, 1))
            ok = found >= 0
            if ok.any():
                out.append((size, at[ok], found[ok]))
        return out

    def judge(self, buf, offs):
        """(words, hit words, items, hit ranges) of each row."""
        starts, ends, first = split_words(buf, offs, ALNUM)
        n = len(offs) - 1
        n_hit, items, spans = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
        found = self.hits(buf, starts, ends, first) if len(starts) else []
        if found:
            mask = np.zeros(len(starts), bool)
            pairs = []
            for size, at, key in found:
                mask |= cover(len(starts), at, size)
                x = self.by_len[size]
                count = x.edge[key + 1] - x.edge[key]
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                item = x.item[np.repeat(x.edge[key], count) + step]
                pairs.append(np.stack([np.repeat(np.searchsorted(first, at, "right") - 1, count), self.ids[item]], 1))
            total = np.concatenate(([0], np.cumsum(mask)))
            n_hit = total[first[1:]] - total[first[:-1]]
            for r, i in np.unique(np.concatenate(pairs), axis=0).tolist():
                items[r].append(i)
            for r in np.flatnonzero(n_hit):
                d = np.diff(np.concatenate(([0], mask[first[r]:first[r + 1]].astype(np.int8), [0])))
                spans[r] = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1))]
        return np.diff(first), n_hit, items, spans


def _scanner(shared):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        index = shared.value
        for batch in batches:
            for a, b, buf, offs in slices(batch.column("text")):
                n_words, n_hit, items, spans = index.judge(buf, offs)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())),
                                       pa.array(spans, kind)], names=["doc_id", "n_words", "n_hit", "item_ids", "spans"])
    return scan


def cut_words(text: str, spans) -> str:
    """The text without the hit word ranges; what stood around a range is joined by one space."""
    buf = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = split_words(buf, np.array([0, len(buf)]), ALNUM)
    kept, at = [], 0
    for s in spans:
        kept.append(buf[at:starts[s["start"]]].tobytes().decode().rstrip(" "))
        at = ends[s["end"] - 1]
    kept.append(buf[at:].tobytes().decode().lstrip(" "))
    return " ".join(x for x in kept if x)


def _cleaned(batch, items, spans, least_items):
    """The rows of ``batch`` with fewer than ``least_items`` items, without their hit words."""
    at = batch.schema.get_field_index("text")
    texts = [cut_words(t, s) if t and s and len(i) < least_items else t for t, i, s in zip(batch.column(at).to_pylist(), items, spans)]
    new = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
    return new.filter(pa.array([len(i) < least_items for i in items], pa.bool_()))


def _clean_pass(shared, least_items):
    def run(batches):
        index = shared.value
        for batch in batches:
            items, spans = [], []
            for _, _, buf, offs in slices(batch.column("text")):
                _, _, i, s = index.judge(buf, offs)
                items += i
                spans += s
            if batch.num_rows:
                yield _cleaned(batch, items, spans, least_items)
    return run


def _clean_joined(least_items, names):
    def run(batches):
        for batch in batches:
            items, spans = ([x or [] for x in batch.column(c).to_pylist()] for c in ("_leak_items", "_leak_spans"))
            if batch.num_rows:
                yield _cleaned(batch.select(names), items, spans, least_items)
    return run


def _key(buf, offs):
    return [hashlib.blake2b(buf[offs[r]:offs[r + 1]], digest_size=16).digest() for r in range(len(offs) - 1)]


def _item_rows(k, gram):
    def run(batches):
        for batch in batches:
            ids = batch.column("item_id").to_numpy()
            for size, parts in item_windows(batch.column("text"), k, gram)[0].items():
                h1, h2, item = (np.concatenate(x) for x in zip(*parts))
                yield pa.record_batch([pa.array(np.full(len(h1), size, np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[item])], names=["size", "h1", "h2", "item_id"])
    return run


def _filters(k, gram, bits):
    """One row a task: bit tables of the fingerprints and of the windows' hashes."""
    def run(batches):
        tables = np.zeros((2, 1 << bits), bool)
        for batch in batches:
            by_len, prints = item_windows(batch.column("text"), k, gram)
            for g in prints:
                tables[0, g >> np.uint64(64 - bits)] = True
            for parts in by_len.values():
                for h1, _, _ in parts:
                    tables[1, h1 >> np.uint64(64 - bits)] = True
        yield pa.record_batch([pa.array([np.packbits(t).tobytes()], pa.binary()) for t in tables], names=["prints", "windows"])
    return run


def _doc_windows(shared, k, gram, bits, sizes):
    """(text key, size, start, h1, h2) of the windows that the filters let through."""
    def run(batches):
        prints, held = (np.unpackbits(np.frombuffer(x, np.uint8)).view(bool) for x in shared.value)
        for batch in batches:
            for a, b, buf, offs in slices(batch.column("text")):
                starts, ends, first = split_words(buf, offs, ALNUM)
                if not len(starts):
                    continue
                w = [hash_words(buf, starts, ends, True, x) for x in (0, 1)]
                keys, out = np.array(_key(buf, offs), object), []
                for size in sizes:
                    if size == k:
                        at = windows_around(w[0], first, k, gram, lambda g: prints[g >> np.uint64(64 - bits)])
                    else:
                        at = windows(w[0], first, size)[1]
                    h1 = _hash_at(w[0], at, size, 0)
                    at = at[held[h1 >> np.uint64(64 - bits)]]
                    out.append((np.full(len(at), size, np.int32), at))
                size, at = (np.concatenate(x) for x in zip(*out))
                h = [np.concatenate([_hash_at(w[x], p, int(s[0]) if len(s) else k, x) for s, p in out]) for x in (0, 1)]
                row = np.searchsorted(first, at, "right") - 1
                yield pa.record_batch([pa.array(keys[row].tolist(), pa.binary()), pa.array(size), pa.array(at - first[row]), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64))],
                                      names=["text_key", "size", "start", "h1", "h2"])
    return run


def _with_key(names):
    """All columns, the text's key and its number of words."""
    def run(batches):
        for batch in batches:
            keys, n_words = [], []
            for _, _, buf, offs in slices(batch.column("text")):
                keys += _key(buf, offs)
                n_words += np.diff(split_words(buf, offs, ALNUM)[2]).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(keys, pa.binary()), pa.array(n_words, pa.int64())], names=[*names, "_leak_key", "_leak_words"])
    return run


def _joined_hits(docs: DataFrame, items: DataFrame, size: int, k: int, gram: int) -> DataFrame:
    """(text_key, item_ids, spans): a row for each text with hits, by a join of the windows' hashes."""
    spark = docs.sparkSession
    bits = min(28, max(_FILTER_BITS, int(np.ceil(np.log2(8 * max(1, size))))))
    tables = None
    for row in items.select("text").repartition(16).mapInArrow(_filters(k, gram, bits), "prints binary, windows binary").toLocalIterator():
        own = [np.frombuffer(x, np.uint8) for x in row]
        tables = own if tables is None else [a | b for a, b in zip(tables, own)]
    windows_ = stored(items.mapInArrow(_item_rows(k, gram), "size int, h1 long, h2 long, item_id long").distinct(), "leak-windows")
    sizes = sorted(r[0] for r in windows_.select("size").distinct().collect())
    if not sizes:
        return spark.createDataFrame([], f"text_key binary, item_ids array<long>, spans {_SPANS}")
    shared = Shared(spark, [t.tobytes() for t in tables])
    seen = docs.select("text").mapInArrow(_doc_windows(shared, k, gram, bits, sizes), "text_key binary, size int, start long, h1 long, h2 long")
    hits = seen.join(windows_, ["size", "h1", "h2"]).groupBy("text_key").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    joined = F.aggregate(
        "spans", F.array().cast(_SPANS),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
        )).otherwise(F.concat(acc, F.array(s))))
    return stored(hits.select("text_key", "item_ids", joined.alias("spans")), "leaks")


def _prepared(benchmark: DataFrame):
    items = with_columns_of(benchmark, {"item_id": "long", "text": "string"}).where("item_id is not null and text is not null")
    return items, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _index(items: DataFrame, k: int, gram: int) -> Shared:
    rows = items.collect()
    return Shared(items.sparkSession, ItemIndex([r[0] for r in rows], [r[1] for r in rows], k, gram))


@cleared("leaks")
def remove_leaks(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, k: int = 8, gram: int = 5, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without the rows that hold windows of ``least_items`` items or more; the hit words of the others are cut out.

    Each row is judged by its own text, whatever its doc_id; all its columns are kept.
    """
    items, size = _prepared(benchmark)
    if size <= broadcast_bytes:
        return docs.mapInArrow(_clean_pass(_index(items, k, gram), least_items), docs.schema)
    hits = _joined_hits(docs, items, size, k, gram)
    keyed = docs.mapInArrow(_with_key(docs.columns), f"{_ddl(docs)}, _leak_key binary, _leak_words long")
    joined = keyed.join(hits.select(F.col("text_key").alias("_leak_key"), F.col("item_ids").alias("_leak_items"), F.col("spans").alias("_leak_spans")), "_leak_key", "left")
    return joined.select(*docs.columns, "_leak_items", "_leak_spans").mapInArrow(_clean_joined(least_items, docs.columns), docs.schema)


def _ddl(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


@cleared("leaks")
def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 8, gram: int = 5, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (ascending), spans (hit word ranges, end exclusive)."""
    docs = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    items, size = _prepared(benchmark)
    if size <= broadcast_bytes:
        return docs.mapInArrow(_scanner(_index(items, k, gram)), OUT)
    hits = _joined_hits(docs, items, size, k, gram)
    keyed = docs.mapInArrow(_with_key(["doc_id", "text"]), "doc_id long, text string, _leak_key binary, _leak_words long").drop("text")
    joined = keyed.join(hits, keyed["_leak_key"] == hits["text_key"], "left")
    spans = F.coalesce("spans", F.array().cast(_SPANS))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return joined.select("doc_id", F.col("_leak_words").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), spans.alias("spans"))
