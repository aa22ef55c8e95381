"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree whose nodes are paths of
(tag, class).  A node's presentation importance is the entropy of the child
sequences seen there, its content importance the entropy of its blocks' texts,
both over the host's *distinct* pages and scaled to 0..1.  What is the same on
every page has importance 0.  A host's measure is drawn towards the mean measure of
the same path on all hosts by ``shared`` pages, as templates are shared, and both
towards what the markup alone suggests by ``prior`` pages: blocks in the page's
article or main element, and all blocks of a page without one, are likely content
(0.9); blocks beside it are not (0.3).  A block below ``low`` goes.  So one page
is read by its markup, and with every further page the tree decides more.

Only elements that say themselves that they are menu, header, footer, sidebar,
notice, advert, form or comments have importance 0 on any page: by tag (a header
inside an article is its heading, and stays), by role, or by class or id.  A class
or id names its element only if all of its words do (``cookie-notice``, not
``with-sidebar`` or ``legal news``), or if one of its names is one of reader comments;
not if the page's article or main element lies beneath; and not if
it is a paragraph, heading or list item in an article.

The tree lives as rows (host, path, counts), so a host with a third of all
pages is aggregated like any other key.  Judged nodes are few; they are
broadcast behind a size check and otherwise joined by host.

Defined cases: null or empty html gives an empty text; broken markup is read
leniently (implied end tags, unclosed comments run to the end); text outside
any element counts as one block of the body; a null url is the host "".  Paths are
kept as hashes with their parents, so deep nesting costs no more than wide.
"""
from __future__ import annotations

import hashlib
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cleared, stored, table, with_columns_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in "script style template svg iframe textarea title".split()}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
                    "annotation maction math menclose mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext "
                    "munder munderover semantics".split())
_NOISE = frozenset("nav footer header aside form menu dialog head button select fieldset".split())
_WORDS = re.compile(r"[a-z]+")
_NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
                         "sidebar side footer header masthead cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe subscription "
                         "signup login search share sharing social related recommended comment comments reply replies discussion disqus pagination pager toolbar "
                         "widget copyright legal disclaimer skip".split())
#: words that name reader comments, also with these beside them (``comment-list``, ``post-comments``, not ``has-comments``)
_COMMENTS = frozenset("comment comments commentlist commentslist commentform replies disqus".split())
_BESIDE_COMMENTS = frozenset("list area section wrap wrapper body form thread container block box item post user reader text content entry author meta reply respond new more even odd depth".split())
#: text elements that a name doesn't drop inside an article
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: an opening tag ends these open elements
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())


def _of_comments(token) -> bool:
    words = _WORDS.findall(token)
    return not _COMMENTS.isdisjoint(words) and _COMMENTS.union(_BESIDE_COMMENTS).issuperset(words)


def _style(tag, attrs, main):
    """(class part of the path, whether tag or role is one of noise, whether class or id names the element as noise)."""
    noise, named = tag in _NOISE and not (tag == "header" and main), False
    css = ""
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            value = (a or b or c).lower()
            name = name.lower()
            if name == "class":
                css = value
            if name == "role":
                noise |= value in _ROLES
            elif tag not in ("body", "html", "main"):
                if any(map(_of_comments, value.split())):
                    named = True
                elif tag != "article" and not (main and (tag in _TEXTUAL or tag == "header")) and (words := _WORDS.findall(value)) and _NOISE_WORDS.issuperset(words):
                    named = True
    return css, noise, named


def _id(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_ROOT = _id("")


def blocks(html: str):
    """([(path, inside article or main, text)] of blocks that aren't named as noise, {path: child styles}, whether an article was seen)."""
    out, shape, part, ids = [], {}, [], {}
    stack = [("", _ROOT, False, False, ())]  # tag, path, noise, main, elements above named as noise
    count = {}  # how many elements of each tag are open
    named_at, lifted = 0, set()  # lifted: named as noise, but around the page's article or main
    seen = False

    def flush():
        if part:
            text = " ".join("".join(part).split())
            part.clear()
            if text and not stack[-1][2]:
                out.append((stack[-1][1], stack[-1][3], text, stack[-1][4]))

    def pop():
        if stack[-1][0] not in _INLINE:
            flush()
        count[stack.pop()[0]] -= 1

    at = 0
    size = len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            part.append(unescape(html[at:]))
            break
        if m.start() > at:
            part.append(unescape(html[at:m.start()]))
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "br" or not count.get(tag):
                continue
            while stack[-1][0] != tag:
                pop()
            pop()
            continue
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            part.append(" ")
            continue
        inline = tag in _INLINE
        if not inline:
            flush()
        if tag in _VOID:
            continue
        if tag in _ENDS_P:
            _close(stack, {"p"}, pop)
        if tag in _ENDS:
            _close(stack, _ENDS[tag], pop)
        if tag == "body":
            while stack[-1][0] == "head":
                pop()
        _, path, above, main, names = stack[-1]
        css, noise, named = _style(tag, m.group(3), main)
        if tag in ("article", "main") and not main and not named:
            lifted.update(names)
        if named:
            named_at += 1
            names = (*names, named_at)
        seen |= tag in ("article", "main") and not above and lifted.issuperset(names)
        here = path
        if not inline:
            style = f"{tag}.{css}"
            shape.setdefault(path, []).append(style)
            here = ids.get((path, style))
            if here is None:
                here = ids[path, style] = _id(f"{path}/{style}")
        count[tag] = count.get(tag, 0) + 1
        stack.append((tag, here, above or noise, main or tag in ("article", "main") and not named, names))
    flush()
    return [b[:3] for b in out if lifted.issuperset(b[3])], shape, seen


_SCOPE = frozenset("ul ol dl table select article section div main body nav aside footer header form".split())


def _close(stack, tags, pop):
    """Ends an open element of ``tags``, if no container opened after it."""
    for s in reversed(stack):
        if s[0] in tags:
            while stack[-1] is not s:
                pop()
            pop()
            return
        if s[0] in _SCOPE:
            return


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = str.maketrans(_UPPER, _UPPER.lower())


def host_of(url) -> str:
    if not url or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].translate(_FOLD)


def _nodes(batches):
    """(host, page signature, [(path, kind, value)]): the page's style nodes; kind 0 content, 1 presentation, 2 content beside the article."""
    kind = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())]))
    for batch in batches:
        hosts, pages, nodes = [], [], []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            found, shape, seen = blocks(html or "")
            own = [{"path": p, "kind": 2 if seen and not main else 0, "value": _id(t)} for p, main, t in found]
            own += [{"path": p, "kind": 1, "value": _id("|".join(c))} for p, c in shape.items()]
            hosts.append(host_of(url))
            pages.append(_id(",".join(f"{n['path']}.{n['kind']}.{n['value']}" for n in own)))
            nodes.append(own)
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(nodes, kind)], names=["host", "page", "nodes"])


def _texts(batches):
    for batch in batches:
        out = []
        for html, drop, keep in zip(*(batch.column(c).to_pylist() for c in ("html", "drop", "keep"))):
            found, _, seen = blocks(html or "")
            drop, keep = set(drop or ()), set(keep or ())
            out.append("\n".join(t for p, main, t in found if (p in keep if seen and not main else p not in drop)))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def style_importance(pages: DataFrame) -> DataFrame:
    """(host, path, beside, n, importance): a row for each node with blocks; ``n`` block texts on distinct pages, beyond the
    first; the larger of the entropies of its texts and of its child sequences."""
    seen = pages.mapInArrow(_nodes, "host string, page long, nodes array<struct<path:long,kind:int,value:long>>")
    # pages of one signature have the same nodes
    distinct = seen.groupBy("host", "page").agg(F.first("nodes").alias("nodes"))
    rows = distinct.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    counts = rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"))
    total = counts.groupBy("host", "path", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    entropy = F.when(F.col("n") > 1, F.greatest((F.log("n") - F.col("clogc") / F.col("n")) / F.log("n"), F.lit(0.0)))
    both = total.groupBy("host", "path").agg(
        *[F.max(F.when(F.col("kind") == k, x)).alias(c) for k, x, c in ((0, F.col("n"), "n0"), (2, F.col("n"), "n2"), (0, entropy, "h0"), (2, entropy, "h2"), (1, entropy, "shape"))])
    own = F.explode(F.array(*[F.struct(F.lit(b).alias("beside"), (F.col(n) - 1).alias("n"), F.greatest(h, "shape").alias("importance")) for b, n, h in ((False, "n0", "h0"), (True, "n2", "h2"))]))
    return both.select("host", "path", own.alias("x")).select("host", "path", "x.*").where("n is not null")


def judged_nodes(nodes: DataFrame, low: float = 0.5, prior: float = 8.0, shared: float = 4.0) -> DataFrame:
    """(host, path, beside) of the nodes that the tree judges against what the markup suggests."""
    every = nodes.where("n > 0").groupBy("path", "beside").agg((F.sum(F.col("n") * F.col("importance")) / F.sum("n")).alias("mean"), F.sum("n").alias("all"))
    joined = nodes.join(every, ["path", "beside"])
    drawn = F.least(F.col("all"), F.lit(shared))
    weight = F.col("n") + drawn
    measured = (F.col("n") * F.coalesce("importance", F.lit(0.0)) + drawn * F.col("mean")) / weight
    suggested = F.when(F.col("beside"), 0.3).otherwise(0.9)
    importance = (prior * suggested + weight * measured) / (prior + weight)
    return joined.where((importance >= low) == F.col("beside")).select("host", "path", "beside")


@cleared("style-judged")
def extract_text(pages: DataFrame, low: float = 0.5, prior: float = 8.0, shared: float = 4.0, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """One row per page: page_id, url, text."""
    pages = with_columns_of(pages, {"page_id": "long", "url": "string", "html": "string"})
    nodes = stored(style_importance(pages.select("url", "html")), "style-nodes")
    branch = stored(judged_nodes(nodes, low, prior, shared), "style-judged")
    by_host = branch.groupBy("host").agg(F.collect_set(F.when(~F.col("beside"), F.col("path"))).alias("drop"), F.collect_set(F.when(F.col("beside"), F.col("path"))).alias("keep"))
    if branch.count() * 64 <= broadcast_bytes:
        by_host = F.broadcast(by_host)
    host = F.coalesce(F.translate(F.regexp_extract("url", r"://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))
    joined = pages.withColumn("_host", host).join(by_host.withColumnRenamed("host", "_h"), F.col("_host") == F.col("_h"), "left")
    return joined.select("page_id", "url", "html", "drop", "keep").mapInArrow(_texts, "page_id long, url string, text string")


def op6_html(spark, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
