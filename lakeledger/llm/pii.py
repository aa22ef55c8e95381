"""Personal data by weak supervision.

Base spans follow fixed patterns and always stay.  Further candidates are all
spans that some labeler might mean: spelled and unfinished e-mail addresses,
IPv6 addresses, digit runs of a card's length, phone numbers without a plus,
long mixed strings and assigned values (secrets), and bank or tax numbers (id).
Four labelers vote on each (yes, no or abstain): a strict pattern, a gazetteer
(domains, issuers, numbering plans, known prefixes of keys), the words around,
and the form (check digits, kinds of characters).  Expectation-maximisation over
the counts of all vote patterns estimates each labeler's reliability by kind;
base spans are known positives for the labelers that don't repeat the base
pattern.  Its posteriors train a naive Bayes span classifier over votes and
shape features, and candidates that it gives ``threshold`` or more are added.

Candidates are counted over all documents; only the counts of distinct patterns
(some thousands at most, by construction of votes and features) reach the driver.

Defined cases: null and empty texts have no spans; repeated rows are judged
alike; candidates that touch a base span or an earlier candidate are dropped.
"""
from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shared, stored, table, with_columns_of

KINDS = ("email", "ip", "card", "phone", "secret", "id")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and then start."""
    out = []
    if not text or not _ANY.search(text):
        return out
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        hit = _DOMAIN.match(text, at + 1) if start < at else None
        last = at + 1
        if hit:
            out.append((0, start, hit.end()))
            last = hit.end()
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            d = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


_ANY_AT = re.compile(r"[\[({]at[\])}]|\sat\s", re.I)  # in every text that _AT matches
_AT = re.compile(r"(?<!\s)\s*(?:\[at\]|\(at\)|\{at\})\s*|(?<=[A-Za-z0-9._%+-])\s+at\s+", re.I)
_SPELT = re.compile(r"[A-Za-z0-9-]{1,63}(?:\s*(?:\[dot\]|\(dot\)|\{dot\}|\sdot\s|\.)\s*[A-Za-z0-9-]{1,63}){1,4}", re.I)
_BARE_HOST = re.compile(r"[A-Za-z0-9-]{1,63}")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9A-Za-z+.-])00[1-9][0-9]{9,12}(?![0-9A-Za-z])")
_DIGITS = re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[ .-][0-9])")
_MIXED = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}={0,2}")
_ASSIGNED = re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\"?\s{0,8}[:=]\s{0,8}[\"']?([^\s\"',;]{6,})", re.I)
_SLUG_WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])")
_TAX = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_TLD = frozenset("com org net edu gov mil int io de fr es it nl ch at be pl pt uk us ca mx br ar au nz in jp cn kr ru eu info biz co me dev app".split())
_KEY_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-", "sk_live_", "pk_live_", "xox", "eyJ", "AIza", "glpat-", "npm_")
_CUES = {0: re.compile(r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel)\b", re.I),
         1: re.compile(r"\b(?:ip|ipv6|address|host|server|client|login|adresse)\b", re.I),
         2: re.compile(r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|pay(?:ment|ed)?)\b", re.I),
         3: re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b", re.I),
         4: re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|bearer|authorization|credential)", re.I),
         5: re.compile(r"\b(?:ssn|social security|tax|iban|account|konto|cuenta|compte|national id)\b", re.I)}
_OTHERWISE = re.compile(r"\b(?:version|order|invoice|isbn|issn|serial|figure|page|article|sku|commit|sha256|md5|checksum|digest)\b", re.I)


def _outside(found, taken):
    """The candidates that touch neither a span of ``taken`` nor an earlier one, by start, in one sweep."""
    starts, ends = [], []
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out, last = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], s[0], s[2])):
        k = bisect.bisect_left(starts, b) - 1  # the last taken span that begins before the candidate ends
        if a >= last and (k < 0 or ends[k] <= a):
            out.append((kind, a, b))
            last = b
    return out


def candidates(text: str, taken) -> list[tuple]:
    """(kind, start, end) of further candidates that touch no span of ``taken``, by start."""
    found = []
    if _ANY_AT.search(text):
        for m in _AT.finditer(text):
            start = m.start()
            while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            hit = _SPELT.match(text, m.end()) if start < m.start() else None
            if hit:
                found.append((0, start, hit.end()))
    at = text.find("@")
    while at >= 0:
        start = at
        while start > 0 and at - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        hit = _BARE_HOST.match(text, at + 1) if start < at else None
        if hit:
            found.append((0, start, hit.end()))
        at = text.find("@", at + 1)
    if text.count(":") > 1:
        found += [(1, *m.span()) for m in _IPV6.finditer(text)]
    if _DIGIT.search(text):
        found += [(2, *m.span()) for m in _DIGITS.finditer(text)]
        found += [(3, *m.span()) for m in _LOOSE_PHONE.finditer(text)]
        found += [(5, *m.span()) for m in _TAX.finditer(text)]
        found += [(5, *m.span()) for m in _IBAN.finditer(text)]
        found += [(4, *m.span()) for m in _MIXED.finditer(text) if _DIGIT.search(m.group()) and _LETTER.search(m.group())]
    found += [(4, *m.span(1)) for m in _ASSIGNED.finditer(text)]
    return _outside(found, taken)


_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def iban_fits(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, kind: int, start: int, end: int) -> str:
    """A vote of each labeler (pattern, gazetteer, context, form): + (personal), - (not), 0 (abstains); then shape features."""
    s = text[start:end]
    digits = "".join(c for c in s if c in "0123456789")
    before, after = text[max(0, start - 48):start], text[end:end + 24]
    strict = known = form = "0"
    if kind == 0:
        dom = re.split(r"[\s\[\](){}.@]+", s.strip())
        strict = "+" if "@" in s and "." in s or re.search(r"[\[({]at[\])}].*(?:[\[({]dot[\])}]|\.)", s, re.I | re.S) else "-" if s.lower().count(" dot ") != 1 else "0"
        known = "+" if dom[-1].lower() in _TLD else "-"
        form = "-" if any(len(x) > 24 for x in dom) else "+" if all(dom) else "0"
    elif kind == 1:
        strict = "+" if ":" not in s or s.count(":") == 7 or s.count("::") == 1 else "-"
        known = "-" if s.startswith(("0.", "127.", "255.", "::1", "fe80")) else "0"
        form = "-" if ":" in s and not re.search("[A-Fa-f]", s) else "+"
    elif kind == 2:
        strict = "+" if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", s) else "-"
        known = "+" if digits[:1] in ("4", "5", "6") or digits[:2] in ("22", "34", "35", "36", "37", "38") else "-"
        form = "+" if luhn(digits) else "-"
    elif kind == 3:
        strict = "+" if s[0] == "+" or re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s) else "0"
        known = "+" if digits[-10:-9] not in ("", "0", "1") else "-"
        form = "+" if len(digits) >= 10 else "-" if len(digits) < 8 else "0"
    elif kind == 4:
        slug = len(_SLUG_WORD.findall(s)) > 1  # words of letters between dashes: a name or a path
        strict = "-" if slug else "+" if re.fullmatch(r"[0-9a-f]{32,}|[A-Za-z0-9+/_-]{20,}={0,2}", s) else "0"
        known = "+" if s.startswith(_KEY_HEADS) else "-" if slug else "0"
        mixed = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        form = "+" if mixed >= 2 and entropy(s) >= 3 and 10 * len(digits) >= len(s) else "-"
    else:
        tax = bool(_TAX.fullmatch(s))
        strict = "+" if tax or 15 <= len(s.replace(" ", "")) <= 34 else "-"
        known = "-" if tax and (s[:3] in ("000", "666") or s[0] == "9") else "+" if tax else "0"
        form = "0" if tax else "+" if iban_fits(s) else "-"
    cue, other = _CUES[kind].search(before + "\n" + after), _OTHERWISE.search(before[-24:])
    context = "+" if cue and not other else "-" if other and not cue else "0"
    shape = "s" if " " in s else "d" if "-" in s else "p" if "." in s else "n"
    edge = ("a" if start and text[start - 1].isalnum() else "q" if start and text[start - 1] in "\"'=" else "o") + ("a" if end < len(text) and text[end].isalnum() else "o")
    return strict + known + context + form + shape + edge


LABELERS = 4


def _named(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan(batches):
    for batch in batches:
        base, cands, counts, digest = [], [], [[], [], [], []], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            more = candidates(text, spans) if text else []
            name = _named(spans)
            base.append(name)
            digest.append(hashlib.sha256(name.encode()).hexdigest())
            for k in range(4):
                counts[k].append(sum(s[0] == k for s in spans))
            cands.append([{"kind": k, "start": a, "end": b, "base": True, "votes": votes(text, k, a, b)} for k, a, b in spans]
                         + [{"kind": k, "start": a, "end": b, "base": False, "votes": votes(text, k, a, b)} for k, a, b in more])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string())]))
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(cands, kind)],
                              names=["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "found"])


_FOUND = "found array<struct<kind:int,start:long,end:long,base:boolean,votes:string>>"
_HEAD = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string"


class LabelModel:
    """Reliabilities of the labelers on one kind of span by expectation-maximisation, and the classifier that its posteriors train.

    ``items``: {votes: count} of candidates; ``known``: {votes: count} of base spans, which are positive and count at most
    as much as the candidates.  The pattern labeler repeats the base patterns, so base spans don't teach it.
    """

    def __init__(self, items: dict, known: dict, rounds: int = 50):
        self.items = items
        total = sum(known.values())
        self.known = {v: n * min(1.0, sum(items.values()) / total) for v, n in known.items()} if total else {}
        vote = lambda v: v[:LABELERS].count("+") - v[:LABELERS].count("-")
        self.post = {v: 1 / (1 + math.exp(-1.5 * vote(v))) for v in items}
        for _ in range(rounds):
            self.maximise()
            self.post = {v: self._odds(v, self.says) for v in items}
        self.maximise()
        self.shape = self._shapes()

    def maximise(self):
        """Prior, and for each labeler P(+ | class) among its votes; pseudo-counts make it somewhat better than chance."""
        one = sum(n * self.post[v] for v, n in self.items.items())
        self.prior = (one + 1) / (sum(self.items.values()) + 2)
        self.says = []
        for j in range(LABELERS):
            yes, any_ = [0.5, 1.5], [2.0, 2.0]  # classes not, personal
            for v, n in self.items.items():
                if v[j] != "0":
                    for c, p in ((1, self.post[v]), (0, 1 - self.post[v])):
                        any_[c] += n * p
                        yes[c] += n * p * (v[j] == "+")
            for v, n in self.known.items():
                if j and v[j] != "0":
                    any_[1] += n
                    yes[1] += n * (v[j] == "+")
            self.says.append((yes[0] / any_[0], yes[1] / any_[1]))

    def _odds(self, v, says, shape=None):
        z = math.log(self.prior) - math.log(1 - self.prior)
        for j in range(LABELERS):
            if v[j] != "0":
                no, yes = says[j]
                d = math.log(yes / no) if v[j] == "+" else math.log((1 - yes) / (1 - no))
                z += max(d, 0) if v[j] == "+" else min(d, 0)
        for j, table in enumerate(shape or ()):
            z += table.get(v[LABELERS + j], 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def _shapes(self):
        """Log ratio of each value of each shape feature, from the posteriors."""
        out = []
        for j in range(LABELERS, LABELERS + 3):
            sums = [Counter(), Counter()]
            for v, n in self.items.items():
                sums[1][v[j]] += n * self.post[v]
                sums[0][v[j]] += n * (1 - self.post[v])
            values = set(sums[0]) | set(sums[1])
            share = [{x: (s[x] + 1) / (sum(s.values()) + len(values)) for x in values} for s in sums]
            out.append({x: math.log(share[1][x] / share[0][x]) for x in values})
        return out

    def classify(self, v) -> float:
        return self._odds(v, self.says, self.shape)


def estimate(patterns, rounds: int = 50) -> dict:
    """{(kind, votes): probability} of non-base candidates; ``patterns``: (kind, base, votes, count)."""
    out = {}
    for kind in range(len(KINDS)):
        items, known = ({v: n for k, b, v, n in sorted(patterns) if k == kind and b == base} for base in (False, True))
        if items:
            model = LabelModel(items, known, rounds)
            out.update({(kind, v): model.classify(v) for v in items})
    return out


def _finish(shared, threshold):
    def run(batches):
        score = shared.value
        for batch in batches:
            spans = []
            for found in batch.column("found").to_pylist():
                kept = sorted((f["kind"], f["start"], f["end"]) for f in found if f["base"] or score.get((f["kind"], f["votes"]), 0) >= threshold)
                spans.append(_named(kept))
            yield pa.record_batch([*batch.columns[:-1], pa.array(spans, pa.string())], names=[*batch.schema.names[:-1], "spans"])
    return run


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, base counts, base_sha256, spans (``kind:start:end`` in code points, comma-joined)."""
    docs = with_columns_of(docs, {"doc_id": "long", "text": "string"})
    found = stored(docs.mapInArrow(_scan, f"{_HEAD}, {_FOUND}"), "pii-found")
    counts = found.select(F.explode("found").alias("f")).groupBy("f.kind", "f.base", "f.votes").count().collect()
    score = estimate([tuple(r) for r in counts])
    return found.mapInArrow(_finish(Shared(docs.sparkSession, score), threshold), f"{_HEAD}, spans string")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
