"""URL filtering by rules and per-host path-template trees, in DataFrame operations only.

A rule (verdict, "host/path") fits its host and all subdomains where the path
starts with the rule's; the longest rule wins.  Urls without a rule are judged
by the template tree of their host:

* segments are generalised by shape (numbers, hexadecimal ids);
* level by level, a node with more than ``max_children`` children has every
  child below ``1 / max_children`` of its urls replaced by a wildcard;
* a node's remaining children whose tails are distributed like the node's whole
  (Jensen-Shannon divergence below ``divergence``) and whose labels do not
  contradict it are merged into one branch; labelled and unlabelled branches
  never merge, so that each keeps its own count;
* a node with labels has the rate (bad + alpha * rate above) / (urls + alpha):
  its urls without a label count as not bad, so the rate is high only where
  labels cover most of the node.  The rate above a host's root is the share of
  bad among all labels.  A branch without labels takes the rate of the nearest
  node with labels above it, if its tails are distributed like that node's;
* a template's share is (bad + alpha * rate above) / (labels + alpha), or without
  labels the rate it takes; it is rejected when labels of its host reach it and
  its share reaches ``purity``.

Labels are the verdicts of the rules and, as bad, urls with a word of ``seed_words``
in the host or the path (between characters that are neither letters nor digits), so
that paths of one host differ in their labels.  A label is evidence for its template,
not a verdict: a template of few labelled urls stays, and one that labels reach
through similar branches goes without any of its own.  Children are compared with their node's whole, never in pairs.
Levels beyond ``depth`` are one wildcard tail, which is part of the template
language and drops no url.

Defined cases: null urls and urls without ``://`` have empty host and path and
the verdict of an unlabelled template, allow; repeated rows are judged alike.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cleared, maybe_broadcast, stored, table, with_columns_of

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SEED_WORDS = ("casino", "pills", "viagra", "porn", "xxx", "adult", "bet", "bets", "betting", "jackpot", "replica", "payday", "spam", "ads")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url):
    """(host, path) columns."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    whole = F.instr(url, "://") > 0
    host = F.when(whole, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())).otherwise("")
    path = F.when(whole, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host, path, rules=RULES):
    """(rule, verdict) columns of the longest fitting rule, null where none fits."""
    name = verdict = None
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, _, tail = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + tail))
        name = F.when(fits, F.lit(rule)) if name is None else name.when(fits, F.lit(rule))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def shapes(path, depth):
    """Array of exactly ``depth`` + 1 generalised segments; null past the path's end."""
    seg = F.regexp_replace(path, r"(?<=/)[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}(?=[/.]|$)", "{h}")
    seg = F.regexp_replace(seg, r"(?<=/)(?=[^/]*[0-9])(?=[^/]*[a-fA-F])[0-9a-fA-F]{12,}(?=[/.]|$)", "{h}")
    seg = F.regexp_replace(seg, r"[0-9]+", "{n}")
    parts = F.split(seg, "/")
    tail = F.when(F.size(parts) > depth + 1, F.lit("{**}"))
    return F.array(*[F.get(parts, F.lit(i)) for i in range(1, depth + 1)], tail)


def template_tree(urls: DataFrame, depth: int = 6, max_children: int = 20, divergence: float = 0.1, alpha: float = 2.0) -> DataFrame:
    """(host, raw, template, n, bad, good, above, reached) for ``urls`` (host, segs, bad, good): each raw shape's template.

    ``above`` is the rate of the nearest node with labels, and ``reached`` whether
    that is one of the host's; both are the same for all rows of a template.
    """
    tree = urls.groupBy("host", "segs").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    tree = tree.select("host", "segs", F.col("segs").alias("raw"), F.lit("").alias("prefix"), "n", "bad", "good")
    tree = stored(tree, "url-tree")
    prior = tree.agg((F.sum("bad") / F.greatest(F.sum("bad") + F.sum("good"), F.lit(1))).alias("prior")).first()[0]
    prior = F.lit(float(prior or 0.0))
    tree = tree.withColumn("above", prior).withColumn("reached", F.lit(False))
    for level in range(depth + 1):
        seg = F.coalesce(F.col("segs")[level], F.lit("{end}"))
        here = tree.withColumn("seg", seg).withColumn(
            "rest", F.concat_ws("/", F.transform(F.slice("segs", level + 2, depth + 1), lambda x: F.coalesce(x, F.lit("")))))
        if level and not here.where("seg <> '{end}'").limit(1).count():
            break
        kids = here.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("kn"), F.sum("bad").alias("kbad"), F.sum("good").alias("kgood"))
        node = kids.groupBy("host", "prefix").agg(F.count("*").alias("k"), F.sum("kn").alias("pn"), F.sum("kbad").alias("pbad"), F.sum("kgood").alias("pgood"))
        kids = kids.join(node, ["host", "prefix"])
        rare = (F.col("k") > max_children) & (F.col("kn") * max_children < F.col("pn")) & (F.col("seg") != "{end}")
        # a child's tails against the node's: Jensen-Shannon divergence, term by term
        tails = here.groupBy("host", "prefix", "seg", "rest").agg(F.sum("n").alias("tn"))
        pooled = here.groupBy("host", "prefix", "rest").agg(F.sum("n").alias("ptn"))
        js = tails.join(pooled, ["host", "prefix", "rest"]).join(kids.select("host", "prefix", "seg", "kn", "pn"), ["host", "prefix", "seg"])
        p, q = F.col("tn") / F.col("kn"), F.col("ptn") / F.col("pn")
        m = (p + q) / 2
        js = js.groupBy("host", "prefix", "seg").agg((F.sum(p * F.log2(p / m) + q * F.log2(q / m)) / 2).alias("shared"), F.sum(q).alias("seen"))
        js = js.select("host", "prefix", "seg", (F.col("shared") + (1 - F.col("seen")) / 2).alias("js"))
        labelled = F.col("kbad") + F.col("kgood") > 0
        total = F.col("pbad") + F.col("pgood")
        rate = F.col("pbad") / total
        z = F.abs(F.col("kbad") / (F.col("kbad") + F.col("kgood")) - rate) / F.sqrt(F.greatest(rate * (1 - rate), 1 / (4 * total)) / (F.col("kbad") + F.col("kgood")))
        alike = (F.col("js") < divergence) & (F.col("k") > 1) & (F.col("seg") != "{end}")
        new = F.when(rare, F.when(labelled, F.lit("{*l}")).otherwise(F.lit("{*}"))).when(
            alike & labelled & (z < 2), F.lit("{~l}")).when(alike & ~labelled, F.lit("{~}")).otherwise(F.col("seg"))
        # a rare branch without labels that isn't like its node may not share a wildcard with those that are
        new = F.when(rare & ~labelled & alike, F.lit("{*~}")).otherwise(new)
        evident = (total > 0) & (F.col("seg") != "{end}")
        spreads = labelled | alike
        names = kids.join(js, ["host", "prefix", "seg"]).select(
            "host", "prefix", "seg", new.alias("new"), evident.alias("evident"), spreads.alias("spreads"), "pn", "pbad")
        rate = (F.col("pbad") + alpha * F.col("above")) / (F.col("pn") + alpha)
        tree = stored(here.join(names, ["host", "prefix", "seg"]).select(
            "host", "segs", "raw", F.when(F.col("seg") == "{end}", F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), F.col("new"))).alias("prefix"),
            "n", "bad", "good",
            F.when(~F.col("evident"), F.col("above")).when(F.col("spreads"), rate).otherwise(prior).alias("above"),
            F.when(~F.col("evident"), F.col("reached")).otherwise(F.col("spreads")).alias("reached")), "url-tree")
    return tree.select("host", "raw", F.col("prefix").alias("template"), "n", "bad", "good", "above", "reached")


@cleared("url-judged")
def filter_urls(pages: DataFrame, rules=RULES, seed_words=SEED_WORDS, depth: int = 6, max_children: int = 20, divergence: float = 0.1,
                alpha: float = 2.0, purity: float = 0.8) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, bad_share."""
    pages = with_columns_of(pages, {"page_id": "long", "url": "string"})
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    words = F.split(F.concat_ws("/", "host", F.translate("path", _UPPER, _UPPER.lower())), "[^a-z0-9]+")
    seeded = F.arrays_overlap(words, F.array(*map(F.lit, seed_words))) if seed_words else F.lit(False)
    urls = urls.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("segs", shapes(F.col("path"), depth))
    marked = urls.select("host", "segs", F.coalesce((F.col("ruled") == "block") | (F.col("ruled").isNull() & seeded), F.lit(False)).cast("long").alias("bad"),
                         F.coalesce(F.col("ruled") == "allow", F.lit(False)).cast("long").alias("good"))
    tree = template_tree(marked, depth, max_children, divergence, alpha)
    share = (F.sum("bad") + alpha * F.first("above")) / (F.sum("bad") + F.sum("good") + alpha)
    evident = F.first("reached") | (F.sum(F.col("bad") + F.col("good")) > 0)
    judged = tree.groupBy("host", "template").agg(share.alias("bad_share"), evident.alias("evident"))
    known = stored(tree.join(judged, ["host", "template"]).select(
        F.col("host").alias("_h"), F.col("raw").alias("_s"), "template", "bad_share", "evident"), "url-judged")
    known = maybe_broadcast(known, 400)
    out = urls.join(known, (F.col("host") == F.col("_h")) & (F.col("segs") == F.col("_s")), "left")
    own = F.when(F.col("evident") & (F.col("bad_share") >= purity), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "bad_share")


def op3_urls(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
