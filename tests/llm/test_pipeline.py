"""Each stage of the corpus pipeline against brute force on a small fixture."""
import math
import random
import re

import pytest
from pyspark.sql import functions as F

cp = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows():
    r = random.Random(11)
    line = lambda k: " ".join(f"w{r.randrange(400)}" for _ in range(k))
    shared = ["This line of the licence stands at the end of many documents: " + str(i) for i in range(3)]
    item = [" ".join(f"item{k}word{j}" for j in range(14)) for k in range(3)]
    out = []
    for i in range(90):
        text = [line(30), line(25)] + ([shared[i % 3]] if i % 2 else [])
        if i % 10 == 3:
            text.insert(1, "x " + item[i % 3] + " y")
        if i % 30 == 7:
            text += [item[0], item[1]]
        if i % 7 == 5:
            text[0] = "snarl grubby snarl vexing " * 3 + text[0]
        out.append((i, "\n".join(text), "en", "a" if i % 3 else None, 1))
    words = out[10][1].split(" ")
    out += [(200, " ".join(words[:20] + ["changed"] + words[21:]), "en", "b", 1), (201, out[14][1].upper(), "en", "b", 1), (7, "another text under an id that is taken", "en", "b", 1),
            (None, out[12][1], "en", None, 1), (None, None, None, None, None), (300, "", None, "b", 0), (12, out[12][1], "en", "a", 1)]
    return out, item


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    out, item = rows()
    d = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit("clash")).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(item)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 5)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def of(df):
    return sorted(((r.doc_id, r.text or "") for r in df.collect()), key=repr)


def sets(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    every = of(docs)

    now = cp.toxicity(spark, docs, data)
    assert now.columns == list(cp.COLUMNS)
    want = [x for x in every if "snarl" not in x[1]]
    assert of(now) == want

    now = cp.stored(now, "t")
    count, last = {}, {}
    for i, t in want:
        for k in {x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")}:
            count[k] = count.get(k, 0) + 1
            last[k] = max(last.get(k, -1), -1 if i is None else i)
    gone = {k for k in count if len(k) >= 40 and count[k] >= 5 and last[k] >= 0}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    want = sorted(((i, "\n".join(x for x in t.split("\n") if key(x) not in gone or last[key(x)] == i)) for i, t in want), key=repr)
    now = cp.stored(cp.line_dedup(spark, now, data), "t")
    assert of(now) == want and gone

    own, root = [sets(t) for _, t in want], list(range(len(want)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(own)):
        for j in range(i):
            if own[i] == own[j] or len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                root[find(i)] = find(j)
    now = cp.stored(cp.near_dedup(spark, now, data), "t")
    kept = of(now)
    groups = {}
    for i, x in enumerate(want):
        groups.setdefault(find(i), []).append(x)
    assert len(kept) == len(groups) < len(want)
    for g in groups.values():
        here = [x for x in kept if x in g]
        least = min((x for x, _ in g if x is not None), default=None)
        assert any(x == least for x, _ in here), g
    assert (7, "another text under an id that is taken") in kept

    item = [WORD.findall(t.lower()) for t in rows()[1]]
    grams = [{tuple(w[j:j + 8]) for j in range(len(w) - 7)} for w in item]

    def cut(text):
        w = WORD.findall((text or "").lower())
        hit, found = set(), set()
        for j in range(len(w) - 7):
            for k, g in enumerate(grams):
                if tuple(w[j:j + 8]) in g:
                    hit.update(range(j, j + 8))
                    found.add(k)
        return None if len(found) > 1 else [x for j, x in enumerate(w) if j not in hit]
    want = sorted(((i, c) for i, t in kept if (c := cut(t)) is not None), key=repr)
    now = cp.stored(cp.decontamination(spark, now, data), "t")
    got = sorted(((i, WORD.findall(t.lower())) for i, t in of(now)), key=repr)
    assert len(got) == len(want) < len(kept)
    for a, b in zip(got, want):
        assert a == b, (a[0], [x for x in zip(a[1], b[1]) if x[0] != x[1]][:4], len(a[1]), len(b[1]))

    out = cp.mixing(spark, now, data).collect()
    size = {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + r.size
    left, target = 1.5 * sum(size.values()), {}
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    free = set(size)
    while free:  # water filling, step by step
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > 2 * size[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        free -= full
    assert len(out) == len(got) and all(math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.taken == r.copies * r.size <= 2 * r.size for r in out)


def test_run_and_empty_tables(spark, data, tmp_path):
    assert cp.run(spark, data).count() > 50
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
