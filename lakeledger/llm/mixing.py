"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source the documents stand in a fixed order (size class, sub-bucket,
size, doc_id).  Each is expected ``rate = target / source_size`` times; the
prefix sum of the expected copies plus one random offset of the source crosses
integer boundaries, and each crossing emits the document once.  The prefix sum
has two levels, buckets and rows in a bucket, so a source with a third of all
rows is never one task.

Targets: the sources by code point, null last, weigh ``weights`` in turn and
share ``total_num / total_den`` of all sizes; a target stops at ``cap`` times
its source's size, and the excess is reshared by weight (water filling, solved
in closed form over the sources ordered by size / weight).

Defined cases: null text has size 0; a document of size 0 takes 0 words; a null
doc_id sorts first; repeated rows each get their own place in the order; null
is a source of its own.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, with_columns_of

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=(3, 1, 2), total_num: int = 3, total_den: int = 2, cap: int = 2) -> DataFrame:
    """(source, source_size, n_docs, target) of each source; one row per source, so its windows are small."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    named = per.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                             ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    s = (named.withColumn("total", F.sum("source_size").over(whole))
         .withColumn("capped_before", F.coalesce(F.sum(F.col("source_size") * cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("free", F.col("total") * total_num - F.col("capped_before") * total_den)  # times total_den
         .withColumn("fits", F.col("free").cast("double") * F.col("w") <= F.col("source_size").cast("double") * (cap * total_den) * F.col("w_left")))
    first = s.withColumn("level", F.row_number().over(by_ratio)).withColumn("from_level", F.min(F.when(F.col("fits"), F.col("level"))).over(whole))
    top = F.max(F.when(F.col("level") == F.col("from_level"), F.struct("free", "w_left"))).over(whole)
    out = first.withColumn("top", top)
    target = F.when(F.col("from_level").isNull() | (F.col("level") < F.col("from_level")), (F.col("source_size") * cap).cast("double")).otherwise(
        (F.col("top.free") * F.col("w")).cast("double") / (F.col("top.w_left") * total_den).cast("double"))
    return out.select("source", "source_size", "n_docs", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words."""
    docs = with_columns_of(docs, {"doc_id": "long", "source": "string", "text": "string"})
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), total_num: int = 3, total_den: int = 2, cap: int = 2,
                seed: str = "mix", bucket_rows: int = 100_000) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = stored(sized(docs), "mix-sizes")
    targets = stored(source_targets(sizes, weights, total_num, total_den, cap), "mix-targets")
    buckets = max(1, -(-(targets.agg(F.max("n_docs")).first()[0] or 0) // bucket_rows))
    number = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00null"))
    placed = sizes.withColumn("class", F.length(F.bin("size"))).withColumn("bucket", (number(text("doc_id")) % buckets).cast("int"))
    counts = placed.groupBy("source", "class", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("bucket").alias("b"), before.alias("before"))
    rates = targets.select(F.col("source").alias("t"), "source_size", "target", (number(F.concat(F.lit(seed + ":"), text("source"))) / F.lit(float(1 << 32))).alias("u"))
    offsets = offsets.join(rates, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    rank = F.row_number().over(Window.partitionBy("source", "class", "bucket").orderBy("size", "doc_id"))
    ranked = placed.withColumn("rank", rank)
    joined = ranked.join(offsets, ranked["source"].eqNullSafe(offsets["s"]) & (ranked["class"] == offsets["c"]) & (ranked["bucket"] == offsets["b"]))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    i = F.col("before") + F.col("rank")
    copies = (F.floor(rate * i + F.col("u")) - F.floor(rate * (i - 1) + F.col("u"))).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
