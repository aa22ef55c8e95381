"""What keeps an executor's memory small between stages."""
import glob

import corpus_pipeline as cp
from lakeledger.llm import line_dedup, shared
from lakeledger.llm.line_dedup import LineRuns, line_keys
from lakeledger.llm.shared import _BATCH, heap_returned, modest_batches, return_heap, stored


def _collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans)


def test_heap_is_returned_before_a_stage(spark, tmp_path):
    before = _collections(spark)
    assert return_heap(spark) == spark.sparkContext.defaultParallelism
    assert _collections(spark) >= before + 1
    docs = spark.createDataFrame([(1, "a b", "en", "x", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    before = _collections(spark)
    cp.mixing(spark, docs, str(tmp_path))
    assert _collections(spark) > before


def test_batches_are_modest_unless_set(spark):
    had = spark.conf.get(_BATCH)
    try:
        spark.conf.set(_BATCH, "10000")
        modest_batches(spark)
        assert spark.conf.get(_BATCH) == "1000"
        spark.conf.set(_BATCH, "77")
        modest_batches(spark)
        assert spark.conf.get(_BATCH) == "77"
    finally:
        spark.conf.set(_BATCH, had)


def test_heap_is_returned_within_a_stage_too(spark, monkeypatch):
    times = []
    monkeypatch.setattr(shared, "return_heap", lambda spark: times.append(clock[0]))
    clock = [100.0]

    def tick():
        clock[0] += 1
        return clock[0]
    monkeypatch.setattr(shared.time, "monotonic", tick)
    docs = spark.createDataFrame([(i, f"{'the same long line in every document here':50}\n{i}") for i in range(8)], "doc_id long, text string")
    stage = heap_returned(lambda spark: line_dedup.dedup_lines(docs).count())
    assert stage(spark) == 8
    assert len(times) > 1
    # each return seems to take one second here: nine more pass before the next
    assert all(b - a >= 10 for a, b in zip(times, times[1:]))
    shared.return_heap_if_due(spark)
    had = len(times)
    stored(docs, "outside")  # no stage is at work
    assert len(times) == had and not shared._DUE


def test_small_runs_are_few_files_that_joins_do_not_move(spark):
    docs = spark.createDataFrame([(i, f"line {i:060}\n{'x' * 45}") for i in range(60)], "doc_id long, text string")
    keys = line_keys(docs).select("doc_id", "key")
    runs = LineRuns(spark, fanout=9, rows=keys.count(), bucket_rows=50)
    assert runs.buckets == 3 < int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert LineRuns(spark, rows=0).buckets == 1 and LineRuns(spark, rows=10 ** 9).buckets == LineRuns(spark).buckets == 4
    runs.add(keys.where("doc_id < 30"))
    runs.add(keys.where("doc_id >= 30"))
    for _, name in runs.runs:
        path = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()[1].removeprefix("file:")
        files = glob.glob(path + "/*")
        assert 0 < len(files) <= 3 and not any("_SUCCESS" in f for f in files)
    own = spark.table(runs.runs[0][1])
    plan = own.join(spark.table(runs.runs[1][1]).select("key").hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan
    keyed = stored(keys.groupBy("key").count(), "keyed")
    plan = runs.unseen(keyed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(key" in plan and ", 3)" in plan, plan
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tally were large
        plan = runs.totals()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan, plan  # the tally's alone
    totals = {bytes(r["key"]): (r["n_docs"], r["last_doc"]) for r in runs.totals().collect()}
    runs.close()
    assert len(totals) == 61 and sorted(totals.values())[-1] == (60, 59) and sum(n == 1 for n, _ in totals.values()) == 60
