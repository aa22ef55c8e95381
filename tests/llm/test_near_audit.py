import time

import numpy as np

from lakeledger.llm import near_dedup as nd


def test_links_of_small_families_beside_a_big_one_are_found(monkeypatch):
    r = np.random.default_rng(1)
    big = np.repeat(r.integers(0, 2**63, (1, 2), dtype=np.uint64), 100, 0)
    codes = np.concatenate([big, np.repeat(r.integers(0, 2**63, (40, 2), dtype=np.uint64), 2, 0)])

    class Poor:  # finds the big family, but of a pair only the query itself
        def __init__(self, codes):
            self.codes = codes

        def search(self, queries, beam):
            d = nd.hamming(queries[:, None], self.codes[None])
            d[np.arange(len(d)) >= 100] = 1 << 20
            np.fill_diagonal(d, 0)
            at = np.argsort(d, 1, kind="stable")[:, :beam]
            d = np.take_along_axis(d, at, 1)
            return np.where(d < 1 << 20, at, -1), d
    monkeypatch.setattr(nd, "SmallWorld", Poor)
    edges, recall = nd.graph_neighbours(codes, codes, np.arange(180) * 100, 20)
    assert {(i, i ^ 1) for i in range(100, 180)} <= {(i, j) for i, j, _ in edges.tolist()} and recall == 1


def test_a_cluster_of_5000_goes_through_the_graph(monkeypatch):
    r = np.random.default_rng(2)
    centre = np.unpackbits(r.integers(0, 2**63, 2, dtype=np.uint64).view(np.uint8))
    flips = np.zeros((5000, 128), np.uint8)
    for row in flips:
        row[r.choice(128, r.integers(1, 9), replace=False)] = 1
    codes = np.packbits(centre ^ flips, axis=1).view(np.uint64)
    built, init = [], nd.SmallWorld.__init__

    def counted(self, codes, **options):
        built.append(len(codes))
        init(self, codes, **options)
    monkeypatch.setattr(nd.SmallWorld, "__init__", counted)
    began = time.time()
    links = nd.nearest_links(codes, 38)
    assert time.time() - began < 10 and built and built[0] > 3000 and len(links) < 12 * 5000
    order = np.argsort(links[:, 2], kind="stable")
    assert len(nd._forest(links[order], links[order, 0], links[order, 1], 5000)) == 4999
