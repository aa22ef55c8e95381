"""No rank decides which terms become seeds, are expanded, or are walked to."""
import random

import numpy as np
import pyarrow as pa

from lakeledger.llm.shared import Shared
from lakeledger.llm.toxicity import _Counts, _merged, induce, walk, walk_apart

GOOD = [f"g{i}" for i in range(400)]


def test_every_term_that_qualifies_is_a_seed(spark):
    r = random.Random(5)
    bad = [f"b{i:03d}x" for i in range(300)]
    rows = [(i, " ".join(r.choice(GOOD) for _ in range(40)), 0) for i in range(2700)]
    for _ in range(6):
        r.shuffle(bad)
        for a in range(0, len(bad), 5):  # toxic words stand too far apart to be each other's neighbours
            rows.append((len(rows), " ".join(w for b in bad[a:a + 5] for w in [b, *(r.choice(GOOD) for _ in range(7))]), 1))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    polarity = induce(d.select("doc_id", "text"), d.select("doc_id", "toxic")).of_words(*bad, *GOOD)
    assert (polarity[:300] > 1).all() and (polarity[300:] < 0.5).all()


def test_walks_go_on_until_no_term_is_left_to_expand(spark):
    r = random.Random(8)
    chain = ["snarl", "hidone", "nextwo", "mothree", "lafour"]
    rows = [(i, " ".join(r.choice(GOOD) for _ in range(30)), 0) for i in range(400)]
    rows += [(400 + i, " ".join([*(r.choice(GOOD) for _ in range(15)), "snarl", *(r.choice(GOOD) for _ in range(15))]), 1) for i in range(60)]
    n_labelled = len(rows)
    for a, b in zip(chain, chain[1:]):  # each word is near the one before only
        rows += [(len(rows) + i, " ".join([*(r.choice(GOOD) for _ in range(15)), a, b, *(r.choice(GOOD) for _ in range(15))]), None) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    polarity = induce(d.select("doc_id", "text"), d.where(f"doc_id < {n_labelled}").select("doc_id", "toxic")).of_words(*chain)
    assert (polarity > 1).all()


def test_walk_on_executors_against_walk_on_driver(spark):
    r = np.random.Generator(np.random.PCG64(3))
    n = 50
    own = np.sort(r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    source, target = np.repeat(np.arange(n), 4), r.integers(0, n, 4 * n)
    w = r.random(4 * n) / 4
    starts = [r.random(n) for _ in range(2)]
    starts = [s / s.sum() for s in starts]
    edges = spark.createDataFrame(pa.table({"f": own[source].view(np.int64), "term": own[target].view(np.int64), "w": w})).repartition(3)
    for got, start in zip(walk_apart(edges, own, starts, 0.4, steps=6), starts):
        assert np.allclose(got, walk(n, source, target, w, start, 0.4, steps=6))


def test_packed_counts_against_plain_sums(spark):
    r = np.random.Generator(np.random.PCG64(4))
    expanded = np.sort(r.integers(1, 1 << 63, 40, dtype=np.uint64) * np.uint64(2))
    terms = r.integers(1, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plain, packs = {}, {}
    for _ in range(5):
        counts = _Counts()
        f, h, c = r.integers(-1, 40, 4000).astype(np.int32), r.choice(terms, 4000), r.integers(1, 3, 4000)
        c[0] = 1 << 40
        for x, y, z in zip(f.tolist(), h.tolist(), c.tolist()):
            plain[x, y] = plain.get((x, y), 0) + z
        counts.add(f, h, c)
        for batch in counts.take(7):
            for shard, raw in zip(*(x.to_pylist() for x in batch.columns)):
                packs.setdefault(shard, []).append(raw)
    got = {}
    for own in packs.values():
        rows = _merged(Shared(spark, expanded), 5.0)(pa.table({"pack": pa.array(own, pa.binary())}))
        for f, term, c in zip(*(x.to_pylist() for x in rows.columns)):
            got[-1 if f is None else int(np.searchsorted(expanded, np.int64(f).astype(np.uint64))), int(np.int64(term).astype(np.uint64))] = c
    assert got == {k: v for k, v in plain.items() if k[0] < 0 or v > 5}
