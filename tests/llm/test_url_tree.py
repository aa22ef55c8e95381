"""The template tree against plain dictionaries."""
import math
import random

from pyspark.sql import functions as F

from lakeledger.llm.url_templates import filter_urls, shapes, template_tree


def plain(rows, depth=6, most=20, divergence=0.1, alpha=2.0):
    """{(host, raw): (template, n, bad, good, above, reached)}, level by level."""
    tree = {}
    for host, segs, bad, good in rows:
        t = tree.setdefault((host, segs), [0, 0, 0])
        t[0] += 1
        t[1] += bad
        t[2] += good
    labels = sum(t[1] + t[2] for t in tree.values())
    prior = sum(t[1] for t in tree.values()) / max(1, labels)
    state = {k: ("", prior, False) for k in tree}
    for level in range(depth + 1):
        kids, tails = {}, {}
        for (host, segs), (n, bad, good) in tree.items():
            seg = segs[level] if segs[level] is not None else "{end}"
            node = (host, state[host, segs][0])
            k = kids.setdefault(node, {}).setdefault(seg, [0, 0, 0])
            for x, v in enumerate((n, bad, good)):
                k[x] += v
            rest = tuple(x or "" for x in segs[level + 1:])
            own = tails.setdefault(node, {}).setdefault(seg, {})
            own[rest] = own.get(rest, 0) + n
        new = {}
        for (host, segs), _ in tree.items():
            prefix, above, reached = state[host, segs]
            seg = segs[level] if segs[level] is not None else "{end}"
            own = kids[host, prefix]
            kn, kbad, kgood = own[seg]
            pn, pbad, pgood = (sum(k[x] for k in own.values()) for x in range(3))
            pooled = {}
            for t in tails[host, prefix].values():
                for rest, c in t.items():
                    pooled[rest] = pooled.get(rest, 0) + c
            js = 0.0
            for rest, c in pooled.items():
                q, p = c / pn, tails[host, prefix][seg].get(rest, 0) / kn
                m = (p + q) / 2
                js += (p * math.log2(p / m) if p else 0) / 2 + q * math.log2(q / m) / 2
            if seg == "{end}":
                new[host, segs] = (prefix, above, reached)
                continue
            labelled, total = kbad + kgood > 0, pbad + pgood
            like = js < divergence and len(own) > 1
            close = False
            if labelled:
                rate = pbad / total
                close = abs(kbad / (kbad + kgood) - rate) / math.sqrt(max(rate * (1 - rate), 1 / (4 * total)) / (kbad + kgood)) < 2
            if len(own) > most and kn * most < pn:
                name = "{*l}" if labelled else "{*~}" if like else "{*}"
            elif like and labelled and close:
                name = "{~l}"
            elif like and not labelled:
                name = "{~}"
            else:
                name = seg
            if total > 0:
                spreads = labelled or like
                above, reached = ((pbad + alpha * above) / (pn + alpha) if spreads else prior), spreads
            new[host, segs] = (f"{prefix}/{name}", above, reached)
        state = new
    return {k: (state[k][0], *tree[k], state[k][1], state[k][2]) for k in tree}


def urls(seed):
    r = random.Random(seed)
    out = []
    for h in ("a.com", "b.org", "c.net"):
        for _ in range(250):
            kind = r.choice(["en", "de", "fr"])
            path = r.choice([f"/{kind}/{r.randrange(1000)}", f"/{kind}/{r.randrange(1000)}.html", f"/shop/{r.choice(['casino', 'pills', 'new', 'old'])}/{r.randrange(99)}",
                             f"/u/{r.choice('abcdefghijklmnopqrstuvwxyz')}{r.choice('xyz')}/about", f"/tag/t{r.choice('pqrs')}", "/", ""])
            out.append((h, path))
    return out


def test_tree_matches_plain_dictionaries(spark):
    r = random.Random(9)
    rows = [(h, p, int("casino" in p or "pills" in p or r.random() < 0.02), int("/de/" in p)) for h, p in urls(1)]
    df = spark.createDataFrame(rows, "host string, path string, bad long, good long").withColumn("segs", shapes(F.col("path"), 6))
    raw = [(x.host, tuple(x.segs), x.bad, x.good) for x in df.collect()]
    for options in ({}, {"max_children": 5}, {"divergence": 0.4, "alpha": 1.0}):
        want = plain(raw, 6, options.get("max_children", 20), options.get("divergence", 0.1), options.get("alpha", 2.0))
        got = {(x.host, tuple(x.raw)): (x.template, x.n, x.bad, x.good, x.above, x.reached) for x in template_tree(df.select("host", "segs", "bad", "good"), **options).collect()}
        assert set(got) == set(want)
        for k in want:
            assert got[k][:4] == want[k][:4] and math.isclose(got[k][4], want[k][4], rel_tol=1e-9) and got[k][5] == want[k][5], (k, got[k], want[k])


def test_verdicts_follow_templates_not_words(spark):
    """Urls of one host get different verdicts by their template; one word alone blocks nothing."""
    bad = [f"http://mixed.org/bet/{i}/page" for i in range(40)]
    good = [f"http://mixed.org/news/{i}/page/{x}" for i in range(10) for x in ("print", "full", "short")]
    lone = ["http://lone.org/casino/royale/review"] + [f"http://lone.org/film/{c}/review" for c in "abcdefgh"]
    every = bad + good + lone
    out = filter_urls(spark.createDataFrame(list(enumerate(every)), "page_id long, url string")).collect()
    by = {every[x.page_id]: x.verdict for x in out}
    assert {by[u] for u in bad} == {"block"} and {by[u] for u in good} == {"allow"} and {by[u] for u in lone} == {"allow"}
    quiet = filter_urls(spark.createDataFrame(list(enumerate(every)), "page_id long, url string"), seed_words=()).collect()
    assert {x.verdict for x in quiet} == {"allow"}
