"""SimHash near-deduplication over navigable small-world graphs.

Texts are sets of ``shingle``-word shingles (a shorter text is one shingle of
all its words); near duplicates have a Jaccard similarity of at least
``threshold``.

1. Texts with equal shingle sets form one class; its smallest doc_id stands for it.
2. Each representative gets a 128-bit SimHash, ``bands`` routing keys of ``rows``
   min-hashes each, and one byte of every min-hash.  A routing key names a shard:
   texts as similar as the threshold share a shard but for one pair in 100,000.
3. Every shard is searched by a navigable small-world graph over Hamming distance.
   Its base layer of ``BASE`` members is compared with every query; further members
   are reached over links.  A beam that lies wholly within the radius is widened,
   and one still full after that is compared with all members.
   - Linking turn: the nearest links of each member, cut to a spanning forest, are
     verified.  Hot keys are cut into sub-shards of at most ``shard_rows``; then one
     leader of each component is linked across the sub-shards in the same way.
   - Closing turns: members outside a key's largest component are queries, broadcast
     to all of the key's sub-shards.  The first turn verifies the best candidate
     between components, the last all that are left, so that after it every
     candidate is verified or inside a component.  There, recall is audited against
     exact search for the ids divisible by 100 of each shard, as the mean of the queries' own shares of their
     neighbours without themselves; below ``recall``, or where no audited query has a
     neighbour to tell by, all queries are compared with all members.
4. Candidates are within ``radius`` and not more than four deviations below the
   threshold by the min-hash bytes; they are verified by exact Jaccard similarity of
   the whole shingle sets, and unioned.

``link_recall`` measures the classes against all true links of the ids divisible by 100.

Defined cases: null or wordless texts are all equal to each other; repeated
rows of one doc_id share their class; a null doc_id is in its text's class but
stands for it only if no other id does.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shared, cleared, maybe_broadcast, stored, trimmed, with_columns_of
from .textops import ALNUM, U64, hash_words, int_column, mix, slices, split_words, windows

#: members of a graph's base layer, which every query is compared with
BASE = 64
#: sets of more shingles are compared by 64 bits of hash, others by 32
_WIDE = 1 << 15

_LUT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_LUT = np.ascontiguousarray(_LUT)


def shingles(buf, offs, k):
    """Per row its sorted distinct shingle hashes: (hashes, edges)."""
    starts, ends, first = split_words(buf, offs, ALNUM)
    w = hash_words(buf, starts, ends, True, 0)
    h, _, edge = windows(w, first, k)
    n = np.diff(first)
    out, size = [], []
    for r in range(len(offs) - 1):
        if n[r] >= k:
            x = np.unique(h[edge[r]:edge[r + 1]])
        elif n[r]:
            x = windows(w[first[r]:first[r + 1]], np.array([0, n[r]]), int(n[r]))[0]
        else:
            x = h[:0]
        out.append(x)
        size.append(len(x))
    return (np.concatenate(out) if out else h), np.concatenate(([0], np.cumsum(size)))


def simhash(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """(rows, 2) uint64: 128 majority bits of each row's hashes; rows without hashes are 0."""
    rows = len(edge) - 1
    out = np.zeros((rows, 2), np.uint64)
    some = np.flatnonzero(np.diff(edge))
    if not len(some):
        return out
    cuts = [np.arange(edge[r], edge[r + 1], 255) for r in some]
    owner = np.repeat(np.arange(len(some)), [len(c) for c in cuts])
    both = np.stack([h, mix(h + U64(0xA0761D6478BD642F))], 1).view(np.uint8)
    part = np.add.reduceat(_LUT[both], np.concatenate(cuts), axis=0).view(np.uint8)
    total = np.add.reduceat(part.astype(np.int32), np.searchsorted(owner, np.arange(len(some))), axis=0)
    out[some] = np.packbits(total * 2 > np.diff(edge)[some][:, None], axis=1).view(np.uint64)
    return out


def band_keys(h, edge, bands, rows):
    """(rows, bands) uint64 routing keys, and (rows, bands * rows) one byte of each min-hash; rows without hashes are 0."""
    n = len(edge) - 1
    keys, mins = np.zeros((n, bands), np.uint64), np.zeros((n, bands * rows), np.uint8)
    some = np.flatnonzero(np.diff(edge))
    if not len(some):
        return keys, mins
    at = edge[:-1][some]
    rng = np.random.Generator(np.random.PCG64(7))
    for b in range(bands):
        key = np.full(len(some), U64(b))
        for r in range(rows):
            mul, add = (U64(int(x)) for x in rng.integers(1, 1 << 63, 2))
            least = np.minimum.reduceat(h * (mul | U64(1)) + add, at)
            key = mix(key * U64(0x9E3779B97F4A7C15) + least)
            mins[some, b * rows + r] = mix(least).astype(np.uint8)
        keys[some, b] = key
    return keys, mins


def _signatures(shingle, bands, rows):
    def run(batches):
        for batch in batches:
            for a, b, buf, offs in slices(batch.column("text")):
                h, edge = shingles(buf, offs, shingle)
                sim, (keys, mins) = simhash(h, edge), band_keys(h, edge, bands, rows)
                same = [hashlib.blake2b(h[edge[r]:edge[r + 1]].tobytes(), digest_size=16).digest() for r in range(b - a)]
                yield pa.record_batch([
                    batch.column("doc_id").slice(a, b - a), pa.array(same, pa.binary()), pa.array(np.diff(edge), pa.int64()),
                    pa.array([x.tobytes() + y.tobytes() for x, y in zip(sim, mins)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))],
                    names=["doc_id", "same", "n", "code", "keys"])
    return trimmed(run)


def hamming(a, b):
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


class SmallWorld:
    """Navigable small-world graph over 128-bit codes; searches run for many queries in step.

    The first ``BASE`` nodes of a fixed random order are the base layer, where every
    search begins; each further node is linked to its nearest nodes found so far.
    """

    def __init__(self, codes: np.ndarray, degree: int = 12, beam: int = 32, seed: int = 1):
        self.codes, self.degree = codes, degree
        n = len(codes)
        order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
        self.base = order[:BASE]
        self.links = np.full((n, 2 * degree), -1, np.int64)
        if n <= BASE:
            return
        d = hamming(codes[self.base][:, None], codes[self.base][None])
        np.fill_diagonal(d, 1 << 20)
        at = np.argsort(d, axis=1, kind="stable")[:, :degree]
        self._connect(self.base, self.base[at], np.take_along_axis(d, at, 1))
        done = BASE
        while done < n:
            new = order[done:done + max(BASE, done // 2)]
            self._connect(new, *self.search(codes[new], beam))
            done += len(new)

    def _connect(self, new, near, dist):
        near, dist = near[:, : self.degree], dist[:, : self.degree]
        self.links[new, : near.shape[1]] = near
        src, dst, d = np.repeat(new, near.shape[1]), near.ravel(), dist.ravel()
        ok = dst >= 0
        src, dst, d = src[ok], dst[ok], d[ok]
        who = np.unique(dst)
        old = self.links[who]
        who = np.repeat(who, old.shape[1])
        ok = old.ravel() >= 0
        who, old = who[ok], old.ravel()[ok]
        dst, src = np.concatenate([dst, who]), np.concatenate([src, old])
        d = np.concatenate([d, hamming(self.codes[who], self.codes[old])])
        code = np.unique(np.stack([dst, d, src], 1), axis=0)
        rank = np.arange(len(code)) - np.searchsorted(code[:, 0], code[:, 0])
        # the nearest links stay, and a fixed random choice of the others, which keeps long ways open
        place = np.where(rank < self.degree, rank, self.degree + (mix(code[:, 2].astype(np.uint64)) >> U64(34)).astype(np.int64))
        code = code[np.lexsort((place, code[:, 0]))]
        keep = rank < self.links.shape[1]
        self.links[np.unique(dst)] = -1
        self.links[code[keep, 0], rank[keep]] = code[keep, 2]

    def search(self, queries, beam: int, cells: int = 1 << 23):
        """The ``beam`` nearest nodes found for each query, nearest first, -1 where fewer, and their distances."""
        chunk = max(16, min(512, cells // max(1, len(self.codes)), (1 << 17) // beam))
        out = [self._search(queries[a:a + chunk], beam) for a in range(0, len(queries), chunk)]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def _search(self, q, beam, steps=4):
        m, far = len(q), 1 << 20
        seen = np.zeros((m, len(self.codes)), bool)
        seen[:, self.base] = True
        node = np.broadcast_to(self.base, (m, len(self.base)))
        dist = hamming(q[:, None], self.codes[self.base][None])
        if node.shape[1] < beam:
            pad = ((0, 0), (0, beam - node.shape[1]))
            node, dist = np.pad(node, pad, constant_values=-1), np.pad(dist, pad, constant_values=far)
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        node, dist = np.take_along_axis(node, best, 1), np.take_along_axis(dist, best, 1)
        todo = node >= 0
        live = np.arange(m) if len(self.codes) > len(self.base) else np.zeros(0, np.int64)
        while len(live):
            # the nearest open nodes of every query's beam at once
            want = np.where(todo[live], np.arange(beam)[None], beam)
            pick = np.sort(np.partition(want, min(steps, beam - 1), axis=1)[:, :steps], axis=1)
            some = pick < beam
            pick = np.minimum(pick, beam - 1)
            row = live[:, None]
            todo[np.broadcast_to(row, pick.shape)[some], pick[some]] = False
            nxt = np.where(some[:, :, None], self.links[node[row, pick]], -1).reshape(len(live), -1)
            nxt.sort(axis=1)
            ok = nxt >= 0
            ok[:, 1:] &= nxt[:, 1:] != nxt[:, :-1]
            ok &= ~seen[row, nxt]
            r, c = np.nonzero(ok)
            seen[live[r], nxt[r, c]] = True
            d = np.full(nxt.shape, far, np.int32)
            d[r, c] = hamming(q[live[r]], self.codes[nxt[r, c]])
            node2, dist2 = np.concatenate([node[live], np.where(ok, nxt, -1)], 1), np.concatenate([dist[live], d], 1)
            todo2 = np.concatenate([todo[live], ok], 1)
            best = np.argsort(dist2, axis=1, kind="stable")[:, :beam]
            node[live], dist[live] = np.take_along_axis(node2, best, 1), np.take_along_axis(dist2, best, 1)
            todo[live] = np.take_along_axis(todo2, best, 1)
            live = live[todo[live].any(1)]
        return np.where(dist < far, node, -1), dist


def exact_neighbours(codes, queries, which, radius, cells=1 << 21):
    """(query index, node index, distance) of all nodes within the radius of the queries ``which``, block by block."""
    out, rows = [np.zeros((0, 3), np.int64)], max(1, cells // max(1, len(codes)))
    low, high = np.ascontiguousarray(codes[:, 0]), np.ascontiguousarray(codes[:, 1])
    for at in range(0, len(which), rows):
        own = which[at:at + rows]
        dist = np.bitwise_count(queries[own, :1] ^ low) + np.bitwise_count(queries[own, 1:] ^ high)
        r, c = np.nonzero(dist <= radius)
        out.append(np.stack([own[r], c, dist[r, c].astype(np.int64)], 1))
    return np.concatenate(out)


def graph_neighbours(codes, queries, query_ids, radius, own=None, beams=(32, 128), recall=0.98):
    """(query index, node index, distance) within the radius, and its audited recall.

    ``own``: the node that a query is itself, or -1; by default the queries are the codes.
    A graph below ``recall``, or whose audited queries have no neighbours, isn't used: then
    all are compared, and recall is 1.
    """
    own = np.arange(len(queries)) if own is None else own
    audit = np.flatnonzero(query_ids % 100 == 0)
    if len(audit) < 16:
        audit = np.union1d(audit, np.arange(0, len(queries), max(1, len(queries) // 16)))
    others = lambda e: e[own[e[:, 0]] != e[:, 1]]
    true = np.bincount(others(exact_neighbours(codes, queries, audit, radius))[:, 0], minlength=len(queries))
    audit = audit[true[audit] > 0]
    got = 0.0
    if len(audit):
        graph, left, edges = SmallWorld(codes), np.arange(len(queries)), []
        for beam in beams:
            node, dist = graph.search(queries[left], min(beam, len(codes)))
            full = dist[:, -1] <= radius
            r, c = np.nonzero((dist <= radius) & ~full[:, None] & (node >= 0))
            edges.append(np.stack([left[r], node[r, c], dist[r, c]], 1))
            left = left[full]
            if not len(left):
                break
        edges = np.concatenate([*edges, exact_neighbours(codes, queries, left, radius)])
        found = np.bincount(others(edges)[:, 0], minlength=len(queries))
        got = float((found[audit] / true[audit]).mean())
    if got < recall:
        return exact_neighbours(codes, queries, np.arange(len(queries)), radius), 1.0
    return edges, got


def nearest_links(codes, radius, beam=16, links=8):
    """(node, node, distance) within the radius: the nearest of each node by the graph; equal codes are one node, chained."""
    kinds, first, own = np.unique(codes, axis=0, return_index=True, return_inverse=True)
    own = own.ravel()
    order = np.argsort(own, kind="stable")
    chain = own[order][1:] == own[order][:-1]
    out = [np.stack([order[:-1][chain], order[1:][chain], np.zeros(chain.sum(), np.int64)], 1)]
    if len(kinds) > 1:
        node, dist = SmallWorld(kinds).search(kinds, min(beam, len(kinds)))
        node, dist = node[:, : links + 1], dist[:, : links + 1]
        r, c = np.nonzero((dist <= radius) & (node >= 0) & (node != np.arange(len(kinds))[:, None]))
        out.append(np.stack([first[r], first[node[r, c]], dist[r, c]], 1))
    return np.concatenate(out)


def base_pairs(sim, starts, sizes, radius):
    """(i, j, distance) within the radius for shards that are one base layer, shards of one size at a time."""
    out = [np.zeros((0, 3), np.int64)]
    for m in np.unique(sizes):
        i, j = np.triu_indices(m, 1)
        own = starts[sizes == m]
        for a in range(0, len(own), max(1, (1 << 19) // max(1, len(i)))):
            at = own[a:a + max(1, (1 << 19) // max(1, len(i)))]
            left, right = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            d = hamming(sim[left], sim[right])
            ok = d <= radius
            out.append(np.stack([left[ok], right[ok], d[ok].astype(np.int64)], 1))
    return np.concatenate(out)


def _forest(edges, left, right, n):
    """Places in ``edges`` (sorted, best first) of a spanning forest over ``n`` nodes, whose ends are ``left`` and ``right``."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    keep = []
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            keep.append(k)
    return edges[keep]


_ROWS = "shard long, guest boolean, query boolean, rep long, comp long, n long, code binary"


def _candidates(radius, threshold, kind):
    """Pairs (a, b) of one batch of shards; ``kind``: link (nearest links, a forest over members), join (all candidates of the
    queries, a forest over components) or rest (all candidates of the queries)."""
    def run(key, table):
        get = lambda c: table.column(c).to_numpy()
        order = np.lexsort((get("rep"), get("guest").astype(bool), get("shard")))
        shard, guest, query = get("shard")[order], get("guest").astype(bool)[order], get("query").astype(bool)[order]
        rep, comp, n = get("rep")[order], get("comp")[order], get("n")[order]
        raw = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(rep), -1)[order]
        sim, mins = np.ascontiguousarray(raw[:, :16]).view(np.uint64), raw[:, 16:]
        starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        sizes = np.diff(np.append(starts, len(shard)))
        found = [base_pairs(sim, starts[sizes <= BASE], sizes[sizes <= BASE], radius)]
        for a, m in zip(starts[sizes > BASE], sizes[sizes > BASE]):
            own = sim[a:a + m]
            if kind == "link":
                got = nearest_links(own, radius)
            else:
                home, asks = int((~guest[a:a + m]).sum()), np.flatnonzero(query[a:a + m])
                got, _ = graph_neighbours(own[:home], own[asks], rep[a:a + m][asks], radius, np.where(asks < home, asks, -1))
                got[:, 0] = asks[got[:, 0]]
            found.append(got + np.array([a, a, 0]))
        e = np.concatenate(found)
        i, j = e[:, 0], e[:, 1]
        least = mins.shape[1] * threshold - 4.5 * np.sqrt(mins.shape[1] * threshold * (1 - threshold))
        ok = (comp[i] != comp[j]) & (query[i] | query[j]) & ~(guest[i] & guest[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
        e = e[ok]
        alike = np.concatenate([np.zeros(0, np.int64), *((mins[e[k:k + 65536, 0]] == mins[e[k:k + 65536, 1]]).sum(1) for k in range(0, len(e), 65536))])
        e, alike = e[alike >= least], alike[alike >= least]
        if kind != "rest":
            e = e[np.lexsort((e[:, 1], e[:, 0], e[:, 2], -alike))]
            ends = e[:, :2]
            if kind == "join":
                # a component is one node in each of its shards
                _, place = np.unique(np.stack([shard, comp], 1), axis=0, return_inverse=True)
                ends = place.ravel()[ends]
            e = _forest(e, ends[:, 0], ends[:, 1], len(rep))
        a, b = rep[e[:, 0]], rep[e[:, 1]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    return run


def _sets(shingle):
    def run(batches):
        for batch in batches:
            for a, b, buf, offs in slices(batch.column("text")):
                h, edge = shingles(buf, offs, shingle)
                blob = []
                for r in range(b - a):
                    own = h[edge[r]:edge[r + 1]]
                    blob.append(own.tobytes() if len(own) > _WIDE else np.unique((own >> U64(32)).astype(np.uint32)).tobytes())
                yield pa.record_batch([batch.column("rep").slice(a, b - a), pa.array(np.diff(edge), pa.int64()), pa.array(blob, pa.binary())], names=["rep", "n", "set"])
    return trimmed(run)


def _set(blob, n):
    return np.frombuffer(blob, np.uint64 if n > _WIDE else np.uint32)


def _verify(threshold):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb"))):
                x, y = _set(x, n), _set(y, m)
                if x.dtype != y.dtype:
                    x, y = (np.unique((z >> U64(32)).astype(np.uint32)) if z.dtype == np.uint64 else z for z in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(both >= threshold * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """(u, m): for each node of the edges (a, b) but the smallest of its component, that smallest id; alternating large and
    small stars, tables cut each round, until the stars stay the same."""
    e, last = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc"), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stored(small, "cc")
        # two hashes summed over all rows tell one state of the stars from another
        now = e.agg(F.count("*"), *[F.sum(F.xxhash64("u", "v", F.lit(x)).cast("decimal(38,0)")) for x in (0, 1)]).first()
        if now == last:
            return e.groupBy("u").agg(F.min("v").alias("m"))
        last = now


class _Linker:
    """Candidates, verification and components, turn by turn."""

    def __init__(self, docs, members, shingle, threshold, radius, task_rows):
        self.docs, self.members, self.shingle, self.threshold, self.radius, self.task_rows = docs, members, shingle, threshold, radius, task_rows
        self.comps = members.select("rep", F.col("rep").alias("comp")).distinct()
        self.linked, self.tried = False, None

    def turn(self, rows: DataFrame, kind: str) -> None:
        """``rows``: shard, guest, query, rep, comp, n, code."""
        rows = stored(rows, "near-rows")
        parts = max(-(-rows.count() // self.task_rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        # few bytes but much work: a fixed number of tasks, which adaptive execution leaves alone
        batches = rows.withColumn("task", F.pmod("shard", F.lit(parts * 4)).cast("int")).repartition(parts, "task").groupBy("task")
        pairs = batches.applyInArrow(_candidates(self.radius, self.threshold, kind), "a long, b long").distinct()
        pairs = stored(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), "near-pairs")
        if not pairs.limit(1).count():
            return
        self.tried = pairs if self.tried is None else self.tried.union(pairs)
        good = self._verified(pairs)
        if not good.limit(1).count():
            return
        side = lambda x: self.comps.select(F.col("rep").alias(x), F.col("comp").alias("c" + x))
        between = good.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")) if self.linked else good
        lower = components(between)
        self.comps = stored(self.comps.join(lower, self.comps["comp"] == lower["u"], "left").select("rep", F.coalesce("m", "comp").alias("comp")), "near-comps")
        self.linked = True

    def _verified(self, pairs: DataFrame) -> DataFrame:
        wanted = stored(pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct(), "near-wanted")
        first = self.docs.join(maybe_broadcast(wanted, 16), self.docs["doc_id"] == wanted["rep"]).select("rep", "text")
        sets = stored(first.mapInArrow(_sets(self.shingle), "rep long, n long, set binary").groupBy("rep").agg(F.min(F.struct("n", "set")).alias("s")), "near-sets")
        side = lambda x: sets.select(F.col("rep").alias(x), F.col("s.set").alias("s" + x), F.col("s.n").alias("n" + x))
        sized = pairs.join(side("b"), "b").join(side("a"), "a")
        return stored(sized.mapInArrow(_verify(self.threshold), "a long, b long"), "near-edges")

    def link(self, shard_rows: int) -> None:
        no, yes = F.lit(False).alias("guest"), F.lit(True).alias("query")
        self.turn(self.members.select(F.xxhash64("key", "home").alias("shard"), no, yes, "rep", F.col("rep").alias("comp"), "n", "code"), "link")
        hot = self.members.where("subs > 1").select("key", "rep", "n", "code")
        while self.linked and hot.limit(1).count():
            # one leader of each component stands for it across the sub-shards of a hot key
            leaders = hot.join(self.comps, "rep").groupBy("key", "comp").agg(F.min(F.struct("rep", "n", "code")).alias("s"))
            leaders = stored(leaders.select("key", "comp", "s.*"), "near-leaders")
            counts = leaders.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
            own = leaders.join(counts, "key").withColumn("subs", F.ceil(F.col("c") / shard_rows).cast("int"))
            if not own.limit(1).count():
                break
            before = leaders.count()
            home = F.pmod(F.xxhash64("rep", F.lit(before)), F.col("subs"))
            self.turn(own.select(F.xxhash64("key", home).alias("shard"), no, yes, "rep", "comp", "n", "code"), "link")
            after = leaders.select("rep", "key").join(self.comps, "rep").select("key", "comp").distinct().count()
            if after > 0.8 * before:
                break
            hot = leaders.select("key", "rep", "n", "code")

    def close(self, kind: str) -> None:
        own = stored(self.members.join(self.comps, "rep"), "near-own")
        sizes = own.groupBy("key", "comp").agg(F.count("*").alias("m"))
        top = sizes.groupBy("key").agg(F.max(F.struct("m", F.col("comp").alias("top"))).alias("s"), F.count("*").alias("k")).where("k > 1").select("key", "s.top")
        own = own.join(top, "key").withColumn("query", F.col("comp") != F.col("top"))
        everywhere = F.sequence(F.lit(0), F.col("subs") - 1)
        own = own.withColumn("sub", F.explode(F.when(F.col("query"), everywhere).otherwise(F.array(F.col("home")))))
        self.turn(own.select(F.xxhash64("key", "sub").alias("shard"), (F.col("sub") != F.col("home")).alias("guest"), "query", "rep", "comp", "n", "code"), kind)


@cleared("near-sigs", "near-reps", "near-classes")
def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, bands: int = 16, rows: int = 3, radius: int = 38,
                    shard_rows: int = 20_000, task_rows: int = 50_000) -> DataFrame:
    """One row per document: doc_id, rep_id (smallest id of its equal texts), class_id (smallest of its near duplicates), kept."""
    docs = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    sigs = stored(docs.mapInArrow(_signatures(shingle, bands, rows), "doc_id long, same binary, n long, code binary, keys array<long>"), "near-sigs")
    reps = stored(sigs.where("doc_id is not null").groupBy("same").agg(F.min(F.struct("doc_id", "n", "code", "keys")).alias("s"))
                  .select("same", F.col("s.doc_id").alias("rep"), "s.n", "s.code", "s.keys"), "near-reps")
    routed = stored(reps.where("n > 0").select("rep", F.posexplode("keys").alias("band", "key")).select("rep", F.xxhash64("band", "key").alias("key")), "near-routed")
    counts = routed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = routed.join(counts, "key").withColumn("subs", F.ceil(F.col("c") / shard_rows).cast("int"))
    shared = shared.withColumn("home", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
    linker = _Linker(docs, stored(shared.join(reps.select("rep", "n", "code"), "rep"), "near-members"), shingle, threshold, radius, task_rows)
    linker.link(shard_rows)
    linker.close("join")
    linker.close("rest")
    out = reps.select("same", "rep").join(stored(linker.comps, "near-classes"), "rep", "left")
    return sigs.select("doc_id", "same").join(out, "same", "left").select(
        "doc_id", F.col("rep").alias("rep_id"), F.coalesce("comp", "rep", "doc_id").alias("class_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("comp", "rep"), F.col("rep").isNull()).alias("kept"))


class _Inverted:
    """Query texts' shingles, each with the queries that hold it."""

    def __init__(self, ids, texts, shingle):
        hashes, owner, self.size = [], [], np.zeros(len(ids), np.int64)
        for a, b, buf, offs in slices(pa.array(texts, pa.string())):
            h, edge = shingles(buf, offs, shingle)
            hashes.append(h)
            owner.append(np.repeat(np.arange(a, b), np.diff(edge)))
            self.size[a:b] = np.diff(edge)
        h, o = np.concatenate(hashes), np.concatenate(owner)
        order = np.argsort(h, kind="stable")
        self.h, self.owner, self.ids = h[order], o[order], np.array(ids, np.int64)


def _links(shared, shingle, threshold):
    def run(batches):
        index = shared.value
        for batch in batches:
            ids, null = int_column(batch, "doc_id")
            left, right = [], []
            for a, b, buf, offs in slices(batch.column("text")):
                h, edge = shingles(buf, offs, shingle)
                row = np.repeat(np.arange(b - a), np.diff(edge))
                lo, hi = np.searchsorted(index.h, h, "left"), np.searchsorted(index.h, h, "right")
                count = hi - lo
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                pair, both = np.unique(np.repeat(row, count) * len(index.ids) + index.owner[np.repeat(lo, count) + step], return_counts=True)
                r, q = pair // len(index.ids), pair % len(index.ids)
                ok = (both >= threshold * (np.diff(edge)[r] + index.size[q] - both)) & ~null[a + r] & (ids[a + r] != index.ids[q])
                left.append(index.ids[q[ok]])
                right.append(ids[a + r[ok]])
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(cat(left)), pa.array(cat(right))], names=["a", "b"])
    return run


@cleared()
def link_recall(docs: DataFrame, classes: DataFrame, shingle: int = 5, threshold: float = 0.8, block: int = 2000) -> tuple[int, int]:
    """(true links, links inside one class) of the ids divisible by 100 against all rows, by exact Jaccard over an inverted index of the queries, block by block."""
    docs = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    asks = docs.where("doc_id % 100 = 0")
    blocks = max(1, -(-asks.count() // block))
    total = found = 0
    classes = stored(classes.select("doc_id", "class_id").distinct(), "near-classes")
    for k in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k).collect()
        if not own:
            continue
        index = Shared(docs.sparkSession, _Inverted([r[0] for r in own], [r[1] for r in own], shingle))
        links = docs.mapInArrow(_links(index, shingle, threshold), "a long, b long").distinct()
        side = lambda x: classes.select(F.col("doc_id").alias(x), F.col("class_id").alias("c" + x))
        got = links.join(side("a"), "a").join(side("b"), "b").agg(F.count("*"), F.count_if(F.col("ca") == F.col("cb"))).first()
        total, found = total + got[0], found + got[1]
    return total, found
