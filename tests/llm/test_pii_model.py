"""The label model against expectation-maximisation over single items, and linear time on hostile texts."""
import math
import random
import time

import pytest

from lakeledger.llm.pii import LABELERS, base_spans, candidates, estimate, find_pii


def plain(items, known, rounds=50):
    """Posterior of each item: the same model, item by item."""
    scale = min(1.0, len(items) / len(known)) if known else 0
    post = [1 / (1 + math.exp(-1.5 * sum({"+": 1, "-": -1, "0": 0}[c] for c in v[:LABELERS]))) for v in items]
    for _ in range(rounds + 1):
        prior = (sum(post) + 1) / (len(items) + 2)
        says = []
        for j in range(LABELERS):
            yes, n = [0.5, 1.5], [2.0, 2.0]
            for v, p in zip(items, post):
                for c, q in ((1, p), (0, 1 - p)):
                    n[c] += q * (v[j] != "0")
                    yes[c] += q * (v[j] == "+")
            if j:
                n[1] += scale * sum(v[j] != "0" for v in known)
                yes[1] += scale * sum(v[j] == "+" for v in known)
            says.append((yes[0] / n[0], yes[1] / n[1]))
        last = post
        post = []
        for v in items:
            z = math.log(prior / (1 - prior))
            for j, c in enumerate(v[:LABELERS]):
                if c == "+":
                    z += max(0, math.log(says[j][1] / says[j][0]))
                elif c == "-":
                    z += min(0, math.log((1 - says[j][1]) / (1 - says[j][0])))
            post.append(1 / (1 + math.exp(-z)))
    z = []
    for v, p in zip(items, post):  # the classifier: labelers and shape
        x = math.log(p / (1 - p))
        for j in range(LABELERS, LABELERS + 3):
            values = sorted({w[j] for w in items})
            share = [(sum(q for w, q in zip(items, side) if w[j] == v[j]) + 1) / (sum(side) + len(values)) for side in ([1 - q for q in last], last)]
            x += math.log(share[1] / share[0])
        z.append(1 / (1 + math.exp(-x)))
    return z


def test_model_matches_items_one_by_one():
    r = random.Random(3)
    items, known = [], []
    for _ in range(400):
        true = r.random() < 0.4
        items.append("".join(r.choices("+-0", (7, 1, 2) if true else (2, 6, 2))[0] for _ in range(LABELERS)) + r.choice("sdp") + r.choice("aoq") + r.choice("ao"))
    known = ["+" + "".join(r.choices("+-0", (7, 1, 2))[0] for _ in range(LABELERS - 1)) + "noo" for _ in range(900)]
    patterns = [(2, b, v, own.count(v)) for b, own in ((False, items), (True, known)) for v in set(own)]
    got = estimate(patterns)
    want = plain(items, known)
    assert all(abs(got[2, v] - w) < 1e-6 for v, w in zip(items, want))
    assert estimate([]) == {} and estimate([(0, True, "++++noo", 3)]) == {}


def test_secrets_and_decoys(spark):
    r = random.Random(1)
    rows = []
    for i in range(200):
        key = "".join(r.choice("0123456789abcdef") for _ in range(40))
        rows.append((2 * i, f'some words token = "{key}" and more'))
        rows.append((2 * i + 1, f"order {r.randrange(10**15, 10**16)} of part AB-{i} version 1.2.{i} section-{i}-of-the-long-running-name"))
    out = {x.doc_id: x.spans for x in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[2 * i] == "secret:20:60" for i in range(200))
    assert sum(not out[2 * i + 1] or out[2 * i + 1].startswith("card:6:22") for i in range(200)) == 200
    assert sum(bool(out[2 * i + 1]) for i in range(200)) < 60  # about a tenth pass the check digit, which makes base spans


@pytest.mark.parametrize("unit", [" ", "1 ", "a@", "1", "+1 ", "x: ", "aaaa:", "password ", "(123) ", "AB12 CDEF ", "0-", "a at b  ", "1.", "a.b@"])
def test_hostile_texts_take_linear_time(unit):
    text = "a at b" + unit * (1_000_000 // len(unit)) + "dot c"
    began = time.time()
    candidates(text, base_spans(text))
    assert time.time() - began < 15


def test_long_white_space_is_quick():
    began = time.time()
    assert candidates(" " * 1_000_000 + "dot", []) == [] and candidates("x" + " " * 1_000_000 + "(at) y.z", [])
    assert time.time() - began < 1
