"""Toxicity scoring by lexicon induction.

Terms are words and their prefixes of 5 characters.  Seeds are terms that
labelled documents show to be toxic or clean.  The word graph has every term of
*all* documents as a node, and an edge where a term stands within ``window``
words of another in more documents than chance explains by ``sigma`` deviations,
weighted by positive pointwise mutual information.  Random walks with restart
from the toxic and from the clean seeds give every term they reach, labelled or
not, a polarity: the log ratio of its two visiting probabilities.  A document is
scored by a logistic model of its words' polarities, fitted on the labelled sample.

The graph is never built whole.  Its rows are counted where a walk goes on from:
the first pass over all documents expands every seed, each further pass every term
of at least ``expand`` visiting probability that has no row yet, until none is left;
a walk at any other term starts anew.  Edges between expanded terms are walked on the
driver, or where they are more than ``held`` by the executors, with the same result.
The terms of at least ``least`` probability are the lexicon; those below would have a
polarity of at most ``least`` / ``floor``.

One bound, a parameter: ``sample`` labelled rows of each class (the first by
hash).  All their terms that qualify are seeds.  Near copies (rows with the same four min-hashes)
share the weight of one document among their labels.

Defined cases: null, empty and wordless texts get the model's score of no
evidence; labels that are null or disagree on one doc_id are ignored; without
labels of both classes, or without a toxic seed, every score is 0; repeated rows
are counted and scored each; other columns are not looked at.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import band_keys, shingles
from .shared import Shared, cleared, stored, table, trimmed, with_columns_of
from .textops import ALNUM, hash_words, mix, slices, split_words

#: terms are words and, of longer ones, prefixes of so many characters, which join inflected forms
PREFIXES = (5,)
#: edges of the bands of toxic polarity whose word counts are the features of a document
_BANDS = np.array([0.5, 1.5, 3.0, 4.5])
_FEATURES = len(_BANDS) + 2
#: the weight of one family of copies, so that shares of it are whole numbers
_ONE = 1000


def words_and_prefixes(buf, offs):
    """The hash of each word, per row the index of its first word, and [(place of a word, hash of its prefix)] for each length of prefix."""
    starts, ends, first = split_words(buf, offs, ALNUM)
    h = hash_words(buf, starts, ends, True, 0)
    at = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
    low = np.searchsorted(at, starts)
    n = np.searchsorted(at, ends) - low
    prefixes = []
    for k in PREFIXES:
        longer = np.flatnonzero(n > k)
        prefixes.append((longer, mix(hash_words(buf, starts[longer], at[low[longer] + k], True, 0) + np.uint64(k))))
    return h, first, prefixes


def distinct_terms(buf, offs):
    """(row, hash) of each row's distinct terms, by row."""
    h, first, prefixes = words_and_prefixes(buf, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    row, h = np.concatenate([row, *(row[at] for at, _ in prefixes)]), np.concatenate([h, *(p for _, p in prefixes)])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _marked(batches):
    """Rows with a key of four min-hashes of their 5-word shingles: copies share it, and count as one document."""
    for batch in batches:
        marks = []
        for _, _, buf, offs in slices(batch.column("text")):
            marks += (band_keys(*shingles(buf, offs, 5), 1, 4)[0][:, 0] >> np.uint64(1)).tolist()
        yield pa.record_batch([*batch.columns, pa.array(marks, pa.int64())], names=[*batch.schema.names, "mark"])


def _count_terms(batches):
    """(term, weight of documents, weight of toxic documents), combined within the task."""
    parts, held = [], 0

    def combined():
        h, n, t = (np.concatenate(x) for x in zip(*parts))
        kinds, at = np.unique(h, return_inverse=True)
        return [(kinds, *(np.bincount(at, weights=x, minlength=len(kinds)).astype(np.int64) for x in (n, t)))]

    def rows():
        for h, n, t in combined() if parts else []:
            for a in range(0, len(h), 1 << 17):
                yield pa.record_batch([pa.array(h[a:a + (1 << 17)].view(np.int64)), pa.array(n[a:a + (1 << 17)]), pa.array(t[a:a + (1 << 17)])], names=["term", "n", "t"])
    for batch in batches:
        toxic, weight = batch.column("toxic").to_numpy(), batch.column("weight").to_numpy()
        for a, b, buf, offs in slices(batch.column("text")):
            row, h = distinct_terms(buf, offs)
            own = weight[a:b][row]
            parts.append((h, own, own * toxic[a:b][row]))
            held += len(h)
        if held > 1 << 20:
            parts = combined()
            held = len(parts[0][0])
            if held > 1 << 19:
                yield from rows()
                parts, held = [], 0
    yield from rows()


class _Counts:
    """Counts of (expanded term's index, term), combined as they come."""

    LIMIT = 1 << 19

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, f, h, c):
        self.parts.append((f, h, c))
        self.held += len(h)
        if self.held > 2 * self.LIMIT:
            self.combine()

    def combine(self):
        if not self.parts:
            return
        f, h, c = (np.concatenate(x) for x in zip(*self.parts))
        key = h ^ mix(f.astype(np.uint64))
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        self.parts = [(f[first], h[first], np.bincount(at, weights=c).astype(np.int64))]
        self.held = len(first)

    def full(self):
        return self.held > self.LIMIT

    def take(self, shards):
        """(shard of the term, packed counts), after which nothing is held."""
        self.combine()
        for f, h, c in self.parts:
            shard = (mix(h) % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((f, shard))
            f, h, c, shard = f[order], h[order], c[order], shard[order]
            own = np.unique(shard)
            cuts = np.append(np.searchsorted(shard, own), len(shard))
            blobs = [pack(f[x:y], h[x:y], c[x:y]) for x, y in zip(cuts, cuts[1:])]
            for x in range(0, len(own), 64):
                yield pa.record_batch([pa.array(own[x:x + 64]), pa.array(blobs[x:x + 64], pa.binary())], names=["shard", "pack"])
        self.parts, self.held = [], 0


def _planes(x):
    """The bytes of the numbers by significance, so that compression finds the zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(raw, kind):
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack(f, h, c) -> bytes:
    """Counts sorted by ``f`` in 20 bytes each, of which the shuffle's compression leaves little more than the hash."""
    return _planes(np.diff(f, prepend=np.int32(0)).astype(np.int32)) + h.tobytes() + _planes(c)


def unpack(raw: bytes):
    n = len(raw) // 20
    return np.cumsum(_unplanes(raw[:4 * n], np.int32)).astype(np.int32), np.frombuffer(raw, np.uint64, n, 4 * n), _unplanes(raw[12 * n:], np.int64)


def _merged(shared, sigma):
    """A shard's packed counts summed; pairs that no term's chance could make an edge of, as they stand in at most ``sigma``
    documents, are left out."""
    def run(table):
        expanded, counts = shared.value, _Counts()
        for column in table.column("pack").chunks:
            for raw in column:
                counts.add(*unpack(raw.as_py()))
        counts.combine()
        f, h, c = counts.parts[0]
        some = (f < 0) | (c > sigma)
        f, h, c = f[some], h[some], c[some]
        names = np.zeros(len(f), np.int64) if not len(expanded) else expanded[np.maximum(f, 0)].view(np.int64)
        return pa.table({"f": pa.array(names, mask=f < 0), "term": pa.array(h.view(np.int64)), "c": pa.array(c)})
    return run


def _cooccur(shared, alone, window, shards):
    """Packed (f, term, documents where the term stands near f) for the places f of the expanded terms; if ``alone``, with f -1
    the occurrences of each term, and of all words as term 0."""
    def run(batches):
        expanded, counts = shared.value, _Counts()
        for batch in batches:
            for a, b, buf, offs in slices(batch.column("text")):
                h, first, prefixes = words_and_prefixes(buf, offs)
                n = len(h)
                if not n:
                    continue
                kinds = np.zeros((1 + len(prefixes), n), np.uint64)  # each word's terms, 0 for none
                kinds[0] = h
                for i, (at, p) in enumerate(prefixes):
                    kinds[i + 1, at] = p
                if alone:
                    each, c = np.unique(kinds[kinds != 0], return_counts=True)
                    counts.add(np.full(len(each) + 1, -1, np.int32), np.append(each, np.uint64(0)), np.append(c, n))
                if not len(expanded):
                    continue
                at = np.minimum(np.searchsorted(expanded, kinds), len(expanded) - 1)
                which, pos = np.nonzero(expanded[at] == kinds)
                f = at[which, pos]
                row = np.repeat(np.arange(b - a), np.diff(first))
                parts = []
                for d in range(-window, window + 1):
                    q = pos + d
                    ok = (q >= 0) & (q < n)
                    ok[ok] = row[q[ok]] == row[pos[ok]]
                    for own in kinds:
                        near = own[q[ok]]
                        some = near != 0
                        parts.append((row[pos[ok]][some], f[ok][some], near[some]))
                r, g, t = (np.concatenate(x) for x in zip(*parts))
                # once a document, however often
                _, once = np.unique(mix(t + mix(g.astype(np.uint64) + (r.astype(np.uint64) << np.uint64(32)))), return_index=True)
                counts.add(g[once].astype(np.int32), t[once], np.ones(len(once), np.int64))
            if counts.full():
                counts.combine()
                if counts.full():
                    yield from counts.take(shards)
        yield from counts.take(shards)
    return trimmed(run)


class Lexicon:
    """Terms with their polarity, and the logistic model over document features."""

    def __init__(self, h: np.ndarray, polarity: np.ndarray):
        order = np.argsort(h)
        self.h, self.polarity = h[order], polarity[order]
        self.mean, self.scale = np.zeros(_FEATURES), np.ones(_FEATURES)
        self.weights = np.zeros(_FEATURES + 1)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Polarity of terms by their hash; 0 for those that no walk reached."""
        if not len(self.h):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.polarity[at], 0.0)

    def of_text(self, buf, offs):
        """The polarity of each word, which is that of its most polar term, and per row the index of its first word."""
        h, first, prefixes = words_and_prefixes(buf, offs)
        best = self.of(h)
        for at, p in prefixes:
            own = self.of(p)
            best[at] = np.where(np.abs(own) > np.abs(best[at]), own, best[at])
        return best, first

    def of_words(self, *words: str) -> np.ndarray:
        buf = [np.frombuffer(w.encode(), np.uint8) for w in words]
        return self.of_text(np.concatenate(buf), np.cumsum([0, *map(len, buf)]))[0]

    def features(self, column) -> np.ndarray:
        """(rows, features): how many words fall into each band of polarity, the strongest word, and the share of toxic words."""
        out = np.zeros((len(column), _FEATURES))
        k = len(_BANDS)
        for a, b, buf, offs in slices(column):
            own, first = self.of_text(buf, offs)
            row = np.repeat(np.arange(b - a), np.diff(first))
            band = np.searchsorted(_BANDS, own, "right")
            counts = np.bincount(row * (k + 1) + band, minlength=(b - a) * (k + 1)).reshape(b - a, k + 1)
            out[a:b, :k] = np.log1p(counts[:, 1:])  # clean words take from a word's polarity, but many of them don't excuse a toxic one
            most = np.zeros(b - a)
            np.maximum.at(most, row[own > 0], own[own > 0])
            out[a:b, k] = most
            bad = np.bincount(row, weights=np.where(own > 1, own, 0), minlength=b - a)
            out[a:b, k + 1] = np.log1p(100 * bad / np.maximum(np.diff(first), 1))
        return out

    def score(self, features) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))

    def fit(self, x, y, weight, rounds=50, ridge=1e-2):
        """Weighted logistic regression by Newton steps."""
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        x = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            pull = np.r_[0, np.full(len(w) - 1, ridge * len(x))] / 10
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(len(w)),
                                   x.T @ (weight * (y - p)) - pull * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w


def _score(shared):
    def run(batches):
        for batch in batches:
            got = shared.value.score(shared.value.features(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])
    return trimmed(run)


def walk(n: int, source, target, weight, start: np.ndarray, restart: float, steps: int = 60) -> np.ndarray:
    """Visiting probabilities on the ``n`` expanded terms of a walk from ``start``; what the weights of a term's edges leave
    of 1 goes to terms that aren't expanded, from where the walk starts anew."""
    p = start.copy()
    for _ in range(steps):
        moved = (1 - restart) * np.bincount(target, weights=p[source] * weight, minlength=n)
        p = moved + (1 - moved.sum()) * start
    return p


def _move(shared, own):
    """(target, moved probability of each side) over some edges, summed within the task."""
    def run(batches):
        total = np.zeros((2, len(own.value)))
        for batch in batches:
            source, target = (np.searchsorted(own.value, batch.column(c).to_numpy().view(np.uint64)) for c in ("f", "term"))
            w = batch.column("w").to_numpy()
            for side, p in enumerate(shared.value):
                total[side] += np.bincount(target, weights=p[source] * w, minlength=len(p))
        at = np.flatnonzero(total.any(0))
        for a in range(0, len(at), 1 << 17):
            own_at = at[a:a + (1 << 17)]
            yield pa.record_batch([pa.array(own_at), pa.array(total[0, own_at]), pa.array(total[1, own_at])], names=["at", "m0", "m1"])
    return trimmed(run)


def walk_apart(edges: DataFrame, own: np.ndarray, starts: list[np.ndarray], restart: float, steps: int = 60) -> list[np.ndarray]:
    """``walk`` from both starts over edges (f, term, w) between the terms ``own``, which stay on the executors."""
    spark, p = edges.sparkSession, list(starts)
    names = Shared(spark, own)
    for _ in range(steps):
        rows = edges.mapInArrow(_move(Shared(spark, p), names), "at long, m0 double, m1 double").groupBy("at").agg(F.sum("m0").alias("m0"), F.sum("m1").alias("m1")).toArrow()
        last = p
        p = []
        for side, start in enumerate(starts):
            moved = np.zeros(len(own))
            moved[rows.column("at").to_numpy()] = (1 - restart) * rows.column(f"m{side}").to_numpy()
            p.append(moved + (1 - moved.sum()) * start)
        if max(np.abs(x - y).sum() for x, y in zip(p, last)) < 1e-13:
            break
    return p


def _sample(docs, labels, sample):
    """(doc_id, text, toxic, weight): one row for each family of copies and label among the chosen labelled rows."""
    some = [labels.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "id") for c in (0, 1)]
    rows = docs.join(F.broadcast(some[0].union(some[1])), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")
    marked = rows.mapInArrow(trimmed(_marked), "doc_id long, text string, toxic int, mark long")
    family = marked.groupBy("mark", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("s"), F.count("*").alias("c"))
    whole = family.groupBy("mark").agg(F.sum("c").alias("whole"))
    weight = F.greatest(F.round(_ONE * F.col("c") / F.col("whole")), F.lit(1)).cast("long")
    return family.join(whole, "mark").select("s.doc_id", "s.text", "toxic", weight.alias("weight"))


class _Graph:
    """The rows of the word graph that walks go on from."""

    def __init__(self, docs: DataFrame, sigma: float, window: int, held: int):
        self.docs, self.spark, self.sigma, self.window, self.held = docs.select("text"), docs.sparkSession, sigma, window, held
        self.alone = self.edges = None
        self.expanded = np.zeros(0, np.uint64)
        self.words = 1

    def _frame(self, h, **columns) -> DataFrame:
        names = {"f": np.asarray(h, np.uint64).view(np.int64), **columns}
        return self.spark.createDataFrame(pa.table({k: pa.array(v) for k, v in names.items()}), "f long" + "".join(f", {k} double" for k in columns))

    def occurrences(self, h) -> np.ndarray:
        """How often each term occurs."""
        rows = self.alone.join(F.broadcast(self._frame(h)), F.col("term") == F.col("f")).select("f", "n").toArrow()
        h, found = np.asarray(h, np.uint64), rows.column("f").to_numpy().view(np.uint64)
        out, order = np.zeros(len(h), np.int64), np.argsort(h)
        out[order[np.searchsorted(h[order], found)]] = rows.column("n").to_numpy()
        return out

    def expand(self, h: np.ndarray) -> None:
        """Counts the rows of the terms ``h`` in one pass over all documents; the first pass counts all terms as well."""
        h = np.sort(h)
        first = self.alone is None
        self.spark._jvm.System.gc()  # the shuffle files of the pass before go when the driver collects its garbage
        shared = Shared(self.spark, h)
        shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 2 * self.docs.rdd.getNumPartitions())
        packs = self.docs.mapInArrow(_cooccur(shared, first, self.window, shards), "shard int, pack binary")
        pairs = stored(packs.groupBy("shard").applyInArrow(_merged(shared, self.sigma), "f long, term long, c long"), "tox-pairs")
        if first:
            self.alone = pairs.where("f is null and term <> 0").select("term", F.col("c").alias("n"))
            self.words = max(1, (pairs.where("f is null and term = 0").first() or {"c": 1})["c"])
        n_f = self._frame(h, nf=self.occurrences(h).astype(float))
        expected = F.col("nf") * F.col("n") * F.lit(2 * self.window / self.words)
        weighed = pairs.where("f is not null and f <> term").join(self.alone, "term").join(F.broadcast(n_f), "f").where(
            F.col("c") - expected > self.sigma * F.sqrt(expected + 1)).select("f", "term", F.log(F.col("c") / expected).alias("ppmi")).where("ppmi > 0")
        mass = weighed.groupBy("f").agg(F.sum("ppmi").alias("mass"))
        edges = stored(weighed.join(F.broadcast(mass), "f").select("f", "term", (F.col("ppmi") / F.col("mass")).alias("w")), "tox-edges")
        self.edges = edges if self.edges is None else self.edges.union(edges)
        self.expanded = np.sort(np.concatenate([self.expanded, h]))

    def visited(self, seeds: list[np.ndarray], pulls: list[np.ndarray], restart: float, least: float):
        """(term, probability of the walk from each side's seeds) of the terms visited with at least ``least``."""
        own, n = self.expanded, len(self.expanded)
        inner = stored(self.edges.join(F.broadcast(self._frame(own).withColumnRenamed("f", "g")), F.col("term") == F.col("g")).select("f", "term", "w"), "tox-inner")
        starts = [np.zeros(n) for _ in seeds]
        for start, h, pull in zip(starts, seeds, pulls):
            start[np.searchsorted(own, h)] = pull  # every seed is expanded
        if inner.count() > self.held:
            p = walk_apart(inner, own, starts, restart)
        else:
            rows = inner.toArrow()
            source, target = (np.searchsorted(own, rows.column(c).to_numpy().view(np.uint64)) for c in ("f", "term"))
            order = np.lexsort((target, source))
            source, target, w = source[order], target[order], rows.column("w").to_numpy()[order]
            p = [walk(n, source, target, w, start, restart) for start in starts]
        mass = self._frame(own, p0=p[0], p1=p[1])
        reached = self.edges.join(F.broadcast(mass), "f").groupBy("term").agg(
            *[(F.sum(F.col("w") * F.col(c)) * (1 - restart)).alias(c) for c in ("p0", "p1")]).where(F.greatest("p0", "p1") >= least)
        rows = reached.orderBy("term").toArrow()
        return rows.column("term").to_numpy().view(np.uint64), np.stack([np.round(rows.column(c).to_numpy(), 12) for c in ("p0", "p1")], 1)


@cleared()
def induce(docs: DataFrame, labels: DataFrame, sample: int = 8000, restart: float = 0.4, window: int = 6,
           sigma: float = 5.0, expand: float = 1e-3, least: float = 1e-5, floor: float = 1e-4, held: int = 1 << 22) -> Lexicon | None:
    """The lexicon learned from ``labels`` (doc_id, toxic) and all ``docs`` (doc_id, text); None without both classes."""
    docs = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    labels = with_columns_of(labels, {"doc_id": "long", "toxic": "int"}).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    sizes = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    chosen = stored(_sample(docs, labels, sample), "tox-sample")
    taken = {r[0]: r[1] for r in chosen.groupBy("toxic").agg(F.sum("weight")).collect()}
    if len(taken) < 2:
        return None
    n, t = (taken[0] + taken[1]) / _ONE, taken[1] / _ONE
    counts = chosen.select("text", "toxic", "weight").mapInArrow(trimmed(_count_terms), "term long, n long, t long").groupBy("term").agg(
        (F.sum("n") / _ONE).alias("n"), (F.sum("t") / _ONE).alias("t"))
    a, b = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(a / (t - F.col("t") + 0.5)) - F.log(b / (n - t - (F.col("n") - F.col("t")) + 0.5))
    ranked = stored(counts.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / a + 1 / b)), "tox-terms")
    sides, pulls = [], []
    for which in ("z > 3 and odds > 1", "z < -1 and odds < -0.5"):
        rows = ranked.where(which).select("term", F.abs("z").alias("z")).orderBy("term").toArrow()
        z = rows.column("z").to_numpy()
        sides.append(rows.column("term").to_numpy().view(np.uint64))
        pulls.append(z / max(z.sum(), 1e-300))
    if not len(sides[0]):
        return None
    graph = _Graph(docs, sigma, window, held)
    new = np.concatenate(sides)
    while len(new):
        graph.expand(new)
        h, p = graph.visited(sides, pulls, restart, least)
        new = h[(p.max(1) >= expand) & ~np.isin(h, graph.expanded)]
    known = np.unique(np.concatenate([h, *sides]))
    q = np.zeros((len(known), 2))
    q[np.searchsorted(known, h)] = p
    for side, (own, pull) in enumerate(zip(sides, pulls)):
        q[np.searchsorted(known, own), side] += restart * pull
    lexicon = Lexicon(known, np.log((q[:, 0] + floor) / (q[:, 1] + floor)))
    rows = chosen.mapInArrow(_features(Shared(docs.sparkSession, lexicon)), "doc_id long, toxic int, weight long, f array<double>").orderBy("doc_id", "toxic").toArrow()
    y, weight = rows.column("toxic").to_numpy().astype(float), rows.column("weight").to_numpy() / _ONE
    weight = weight * np.where(y == 1, sizes[1] / taken[1], sizes[0] / taken[0])
    x = rows.column("f").combine_chunks().flatten().to_numpy().reshape(-1, _FEATURES)
    lexicon.fit(x, y, weight * len(y) / weight.sum())
    return lexicon


def _features(shared):
    def run(batches):
        for batch in batches:
            got = shared.value.features(batch.column("text"))
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * _FEATURES, pa.int32()), pa.array(got.ravel()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), batch.column("weight"), f], names=["doc_id", "toxic", "weight", "f"])
    return trimmed(run)


def held_out(doc_id="doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, score, predicted; labels of held-out rows are not looked at."""
    docs = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    lexicon = induce(docs, labels.where(~held_out()), **options)
    if lexicon is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = Shared(docs.sparkSession, lexicon)
    return docs.mapInArrow(_score(shared), "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _clean(shared):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = shared.value.score(shared.value.features(batch.column("text")))
                yield batch.filter(pa.array(got < 0.5))
    return trimmed(run)


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    lexicon = induce(docs, labels.where(~held_out()), **options)
    return docs if lexicon is None else docs.mapInArrow(_clean(Shared(docs.sparkSession, lexicon)), docs.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
