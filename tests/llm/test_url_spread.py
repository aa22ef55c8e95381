from pyspark.sql import functions as F

from lakeledger.llm.url_templates import filter_urls


def test_labels_reach_similar_branches_without_labels(spark):
    rules = tuple(("block", f"shop.com/d{c}/") for c in "abcdefghi") + (("block", "half.com/a/"),)
    urls = [f"http://shop.com/d{c}/{i}" for c in "abcdefghi" for i in range(20)]
    urls += [f"http://shop.com/new/{i}" for i in range(5)] + [f"http://shop.com/about/team/{c}" for c in "abcde"]
    urls += [f"http://half.com/{c}/{i}" for c in "ab" for i in range(20)] + [f"http://other.com/new/{i}" for i in range(5)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = filter_urls(rows, rules, seed_words=()).where(F.col("rule").isNull()).collect()
    got = {(r.host, r.path.split("/")[1]): set() for r in out}
    for r in out:
        got[r.host, r.path.split("/")[1]].add(r.verdict)
    # other tails, a host half of whose urls have labels, and a host without labels stay
    assert got == {("shop.com", "new"): {"block"}, ("shop.com", "about"): {"allow"}, ("half.com", "b"): {"allow"}, ("other.com", "new"): {"allow"}}
