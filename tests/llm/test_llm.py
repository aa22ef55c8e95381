"""The training-data operators against brute force, on small tables with nulls, empty and long texts, repeats and clashing columns."""
import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeledger.llm import near_dedup as nd
from lakeledger.llm import queries as Q
from lakeledger.llm import shared
from lakeledger.llm.decontaminate import decontaminate, remove_leaks
from lakeledger.llm.exact_dedup import exact_groups
from lakeledger.llm.html_extract import blocks, extract_text
from lakeledger.llm.line_dedup import LineRuns, dedup_batch, dedup_lines, line_keys
from lakeledger.llm.mixing import mix_sources
from lakeledger.llm.near_dedup import graph_neighbours, hamming, near_duplicates
from lakeledger.llm.pii import base_spans, find_pii, luhn
from lakeledger.llm.substring_dedup import remove_repeats
from lakeledger.llm.toxicity import induce, reject_toxic, score_toxicity, walk
from lakeledger.llm.url_templates import filter_urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Ünï", "ÀÉ", "日本語", "x" * 70]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    shared = [line(20) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [line(r.randrange(1, 40)) for _ in range(r.randrange(1, 5))] + [s for s in shared if r.random() < 0.3]
        r.shuffle(parts)
        out.append("\n".join(parts))
    out += out[:5] + [out[6].upper(), out[7] + " tail", "", None, None, " \t ", "short one", "short one", "\n\n", line(4000), "x" * 5000]
    return [(i, t, r.choice(["en", None]), r.choice(["a", "a", "b", None]), 0) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows += [(rows[3][0], rows[3][1], "en", "a", 0), (None, rows[4][1], None, "b", None)]  # a repeated row, a null id
    return spark.createDataFrame(rows, DOCS).withColumn("h", F.lit(1)).withColumn("key", F.lit("clash")).withColumn("block", F.lit(0)).repartition(3)


@pytest.fixture(scope="module")
def items(spark, docs):
    t = corpus()
    own = [(i, " ".join(words(t[i][1])[3:20])) for i in range(0, 30, 3)]
    own += [(100, " ".join(words(t[1][1])[:5])), (101, "none of these words are there at all ever"), (102, ""), (103, None), (None, "w1"), (0, own[0][1])]
    return spark.createDataFrame(own, "item_id long, text string").withColumn("doc_id", F.lit(5))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sql(name, docs, items=None):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    if items is not None:
        con.register("benchmark", items.select("item_id", "text").toArrow())
    cur = con.execute(Q.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    return cols, sorted(map(repr, cur.fetchall()))


def spark_rows(df, cols):
    return sorted(repr(tuple(r)) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_queries_match_sql(spark, docs, items, name, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    cols, want = sql(name, docs, items)
    assert spark_rows(Q.QUERIES[name](spark, str(tmp_path)), cols) == want


def test_empty_tables(spark, items):
    d = empty(spark)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (decontaminate(d, items), decontaminate(d, items.limit(0)), exact_groups(d), dedup_lines(d), remove_repeats(d), mix_sources(d),
                near_duplicates(d), find_pii(d), score_toxicity(d, labels), filter_urls(pages), extract_text(pages)):
        assert out.count() == 0


def test_decontaminate_in_blocks_and_removal(spark, docs, items):
    one = spark_rows(decontaminate(docs, items), ["doc_id", "n_words", "n_hit", "item_ids", "spans"])
    assert spark_rows(decontaminate(docs, items, broadcast_bytes=0), ["doc_id", "n_words", "n_hit", "item_ids", "spans"]) == one
    assert any("item_ids=[]" not in x for x in one)
    clean = remove_leaks(docs, items, least_items=2)
    left = decontaminate(clean, items)
    assert left.where("n_hit > 0 and n_words > 60").count() <= decontaminate(docs, items).where("n_hit > 0").count()
    assert set(clean.columns) == set(docs.columns)
    assert spark_rows(remove_leaks(docs, items, least_items=2, broadcast_bytes=0), docs.columns) == spark_rows(clean, docs.columns)
    gone = {r.doc_id for r in decontaminate(docs, items).where("size(item_ids) >= 2").collect()}
    assert gone and not gone & {r.doc_id for r in clean.select("doc_id").collect()}


def test_rows_of_one_id_are_cleaned_each_by_its_own_text(spark):
    item = " ".join(f"i{k}" for k in range(12))
    rows = [(7, "a b c " + item + " d e", "x"), (7, "short", "y"), (None, item, "z"), (None, None, "n"), (8, "", "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    for limit in (0, 1 << 20):
        out = remove_leaks(d, b, broadcast_bytes=limit)
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(7, "a b c d e", "x"), (7, "short", "y"), (None, "", "z"), (None, None, "n"), (8, "", "e")]))
        assert remove_leaks(d.limit(0), b, broadcast_bytes=limit).count() == 0 and remove_leaks(d, b.limit(0), broadcast_bytes=limit).count() == 5


def test_exact_in_slices(spark, docs):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert spark_rows(exact_groups(docs, max_bits=400), cols) == spark_rows(exact_groups(docs), cols)


def test_lines_by_join_and_by_broadcast(spark, docs):
    cols = ["doc_id", "n_lines", "n_dropped", "kept_text"]
    a = spark_rows(dedup_lines(docs), cols)
    assert spark_rows(dedup_lines(docs, broadcast_bytes=0, fanout=2), cols) == a and len(a) == docs.count()


def test_runs_are_disjoint_and_joined_in_place(spark, docs):
    runs = LineRuns(spark, fanout=9)
    lines = line_keys(docs)
    runs.add(lines)
    plan = runs.unseen(lines.select("key"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan  # of the batch, not of the run
    assert runs.add(lines).count() == spark.table(runs.runs[0][1]).count() and spark.table(runs.runs[1][1]).count() == 0
    runs.close()


def test_lines_incremental(spark, docs):
    runs = LineRuns(spark, fanout=2)
    rows = [r for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    seen, want, got = set(), {}, {}
    for b in range(5):
        own = [r for r in rows if r.doc_id % 5 == b]
        fresh = set()
        for r in own:
            kept = []
            for x in (r.text or "").split("\n"):
                k = x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
                if len(k) < 40 or k not in seen:
                    kept.append(x)
                if len(k) >= 40:
                    fresh.add(k)
            want[r.doc_id] = "\n".join(kept)
        seen |= fresh
        got |= {r.doc_id: r.kept_text for r in dedup_batch(runs, spark.createDataFrame(own, "doc_id long, text string")).collect()}
    assert got == want and len(runs.runs) < 5


def test_substrings_in_small_blocks(spark, docs):
    cols = ["doc_id", "n_words", "n_removed", "kept_text"]
    a = spark_rows(remove_repeats(docs), cols)
    assert spark_rows(remove_repeats(docs, block_bytes=2000, cells_per_window=1, shard_entries=100, message_windows=0), cols) == a


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    r = random.Random(5)
    base = [[f"t{r.randrange(5000)}" for _ in range(r.randrange(30, 120))] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:15]:
        for _ in range(r.randrange(1, 6)):
            c = list(b)
            for _ in range(r.choice([1, 1, 2, 6, 20])):
                c[r.randrange(len(c))] = "edit"
            texts.append(" ".join(c))
    family = base[20]
    texts += [" ".join(family[:-1] + [f"v{i}"]) for i in range(60)] + ["", None, "a b", "a b", "a b c"]
    rows = list(enumerate(texts))
    sets = {i: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for base, cut in ((64, 20_000), (8, 20)):
        monkeypatch.setattr(nd, "BASE", base)
        out = near_duplicates(docs, shard_rows=cut)
        got = {r.doc_id: r.class_id for r in out.collect()}
        assert got == {i: find(i) for i in sets}, (base, cut)
    total, found = nd.link_recall(docs, out, block=1)
    mine = [(i, j) for i in sets if i % 100 == 0 for j in sets if i != j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert total == found == len(mine)


def test_small_world_recall():
    r = np.random.default_rng(3)
    codes = r.integers(0, 2**63, (3000, 2), dtype=np.uint64)
    for c in range(0, 600, 6):
        for d in range(1, 6):
            flip = np.zeros(128, np.uint8)
            flip[r.choice(128, 12, replace=False)] = 1
            codes[c + d] = codes[c] ^ np.packbits(flip).view(np.uint64)
    edges, recall = graph_neighbours(codes, codes, np.arange(3000), 30)
    exact = sum(int((hamming(codes, q) <= 30).sum()) for q in codes[:600])
    assert recall >= 0.98 and (edges[:, 0] < 600).sum() >= 0.95 * exact


def test_mix_targets_and_reruns(spark, docs):
    big = docs.unionByName(spark.range(1000, 1600).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 50).cast("int")).alias("text"), F.lit("c").alias("source")), allowMissingColumns=True)
    out = mix_sources(big, bucket_rows=50).collect()
    again = mix_sources(big.repartition(7), bucket_rows=50).collect()
    assert Counter(out) == Counter(again)
    by = {}
    for r in out:
        assert r.taken <= 2 * r.size
        t = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        t[0] += r.taken
        t[3] = max(t[3], r.size)
    assert math.isclose(sum(t[1] for t in by.values()), 1.5 * sum(t[2] for t in by.values()))
    assert all(t[1] <= 2 * t[2] + 1e-6 for t in by.values())
    assert abs(by["c"][0] - by["c"][1]) <= 0.05 * by["c"][1]
    plan = mix_sources(big)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_spans(spark):
    good = next(f"411111111111{i:04d}" for i in range(10_000) if luhn(f"411111111111{i:04d}"))
    text = (f"é a.b@c.de, x@y and z@y.co.uk. 10.0.0.255 1.2.3.256 1.2.3.4.5 card {good[:4]} {good[4:8]}-{good[8:]}, 4111111111111112, "
            "+1 (555) 123-4567 +12 bob (at) mail (dot) com call (212) 555-0199 now " + "1" * 5000 + " " + "a" * 3000 + "@")
    got = find_pii(spark.createDataFrame([(1, text), (2, None), (3, ""), (1, text), (None, "no data 12")], "doc_id long, text string").withColumn("spans", F.lit("x"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and (by[1].n_email, by[1].n_ip, by[1].n_card, by[1].n_phone) == (2, 2, 1, 1)
    assert by[2].spans == by[3].spans == by[None].spans == "" and by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert set(",".join(f"{k}:{a}:{b}" for k, a, b in [("email", 2, 10)]).split(",")) <= set(by[1].spans.split(","))


def test_pii_base_against_plain_patterns():
    r = random.Random(2)
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for _ in range(3000):
        t = "".join(r.choice("a@.1 2-+(4)9%") for _ in range(r.randrange(60)))
        want = []
        for k, p in enumerate(kinds):
            for m in re.finditer(p, t):
                d = re.sub(r"\D", "", m.group())
                if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 16 <= len(d) <= 19 and luhn(d) or k == 3 and 8 <= len(d) <= 15:
                    want.append((k, *m.span()))
        assert base_spans(t) == want, t


def test_toxicity_held_out(spark):
    r = random.Random(4)
    bad, good = ["grub" + s for s in ("ly", "ing", "ster", "ful")] + ["snarl"], [f"g{i}" for i in range(400)]
    rows = []
    for i in range(900):
        toxic = i % 4 == 0
        w = [r.choice(good) for _ in range(40)] + ([r.choice(bad) for _ in range(4)] if toxic else [])
        r.shuffle(w)
        rows.append((i, " ".join(w), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    d = d.union(spark.createDataFrame([(9001, None, None), (9002, "", None), (None, "w", None), (9003, "!" * 10_000, None)], d.schema))
    out = score_toxicity(d, d.where("toxic is not null").select("doc_id", "toxic")).collect()
    held = [(r, rows[r.doc_id][2]) for r in out if r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out) and len(out) == 904
    none = score_toxicity(d, d.limit(0).select("doc_id", "toxic")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}


def test_toxicity_is_induced_beyond_the_labels(spark):
    """Words that only unlabelled texts hold get a polarity by standing near labelled ones; without the walk they have none."""
    r = random.Random(6)
    common = [f"g{i}" for i in range(300)]
    rows = []
    for i in range(1200):
        w = [r.choice(common) for _ in range(30)]
        if i % 4 == 0:
            own = ["snarl", "grubby", "vexing"] + (["hidden", "unseen"] if i >= 600 else [])
            at = r.randrange(30)
            w[at:at] = [r.choice(own) for _ in range(6)]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    words = ["snarl", "vexing", "hidden", "unseen", "g5", "never"]
    with_walk = dict(zip(words, induce(docs, labels).of_words(*words)))
    without = dict(zip(words, induce(docs, labels, restart=1.0).of_words(*words)))
    assert min(with_walk["hidden"], with_walk["unseen"]) > 1 and without["hidden"] == without["unseen"] == with_walk["never"] == 0
    assert with_walk["snarl"] > 1 and abs(with_walk["g5"]) < 1
    again = induce(docs.repartition(5), labels)
    assert (again.h == induce(docs, labels).h).all()


def test_toxicity_walk_against_plain_iteration():
    w = {0: {1: 0.5, 2: 0.3}, 1: {0: 1.0}, 2: {1: 0.4}}  # what is lacking to 1 leads out of the graph
    start = {0: 0.75, 2: 0.25}
    p = dict(start)
    for _ in range(300):
        moved = {x: sum(0.6 * p.get(y, 0) * w[y].get(x, 0) for y in w) for x in w}
        p = {x: moved[x] + (1 - sum(moved.values())) * start.get(x, 0) for x in w}
    edges = [(a, b, x) for a, e in w.items() for b, x in e.items()]
    got = walk(3, *(np.array(c) for c in zip(*edges)), np.array([0.75, 0, 0.25]), 0.4, steps=300)
    assert np.allclose(got, [p[0], p[1], p[2]]) and math.isclose(got.sum(), 1)


def test_reject_toxic_keeps_columns_and_empty_tables(spark):
    d = spark.createDataFrame([(i, "snarl " * 3 + f"w{i}" if i % 3 == 0 else f"calm day w{i}", f"x{i}") for i in range(300)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    out = reject_toxic(d, labels)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == {i for i in range(300) if i % 3}
    assert reject_toxic(d.limit(0), labels).count() == 0 and reject_toxic(d, labels.limit(0)).count() == 300


def test_url_rules_and_templates(spark):
    urls = ["http://Example.NET/en/1?q", "https://a.example.net/de/2", "http://x.net#f", "http://example.com/de/", "http://badexample.com/de/1", "http://e.org/fr/x",
            "http://e.org/en/x", None, "no scheme", "http://", "://h/p"] + [f"http://w.casino.example.com/en/{i}" for i in range(40)] + [
            f"http://w.example.com/{'de' if i % 2 else 'en'}/{i}" for i in range(40)]
    out = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert by[0] == ("example.net", "/en/1", "example.net/en/", "allow") and by[1] == ("a.example.net", "/de/2", "net/", "block")
    assert by[2] == ("x.net", "", None, "allow") and by[3][2:] == ("example.com/de/", "block") and by[4][2] is None
    assert by[5][2:] == ("org/fr/", "allow") and by[6][2] is None and by[7] == by[8] == ("", "", None, "allow") and by[10][:2] == ("h", "/p")
    assert all(by[i][3] == "block" for i in range(11, 51)) and len(out) == len(urls)
    assert all(by[i][3] == ("block" if i % 2 == 0 else "allow") for i in range(51, 91))  # no label spreads to the other branch


def test_html_text(spark):
    page = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=/x>menu</a></nav><div class="ad">buy</div>'
            '<header>top</header><article><h1>A &amp; B</h1><script>x("<p>")</script><p>one<b> two<br>three<p>f&ouml;ur  \n five</p><aside>s</aside>'
            '<form>f</form><ul><li>i<li>j</ul><div class="comments"><p>first!</p></div></article><footer>&copy; me</footer></body>')
    d = spark.createDataFrame([(1, "http://h/1", page), (2, None, None), (3, "http://h/2", ""), (4, "x", "plain &lt; text"), (5, "x", "<p>open <!-- never closed")],
                              "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    by = {r.page_id: r.text for r in extract_text(d).collect()}
    assert by == {1: "A & B\none two three\nför" .replace("för", "föur five") + "\ni\nj", 2: "", 3: "", 4: "plain < text", 5: "open"}


def test_html_style_tree_drops_what_every_page_has(spark):
    page = lambda i: f"<body><div class=x><p>always the same</p></div><div class=y><p>unique {i} words</p></div></body>"
    d = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(20)] + [(99, "http://k/1", page(99))], "page_id long, url string, html string")
    by = {r.page_id: r.text for r in extract_text(d).collect()}
    assert by[3] == "unique 3 words" and by[99] == "always the same\nunique 99 words"
    assert blocks("")[0] == []


def test_operators_leave_only_what_their_results_read(spark, docs, items, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "workdir", lambda spark: f"file://{tmp_path}")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(60)], "doc_id long, toxic int")
    results = [reject_toxic(docs, labels), near_duplicates(docs), dedup_lines(docs), exact_groups(docs), remove_leaks(docs, items, broadcast_bytes=0)]
    assert all(r.count() for r in results)
    names = {n.rsplit("-", 1)[0] for n in os.listdir(tmp_path)}
    assert names == {"near-sigs", "near-reps", "near-classes", "exact-tested", "exact-groups", "leaks"}
