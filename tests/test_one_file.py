"""Single data files that many tasks write."""
import glob
import uuid

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakeledger import LakeTable, Location, catalogue
from lakeledger.operators import joined

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def split(spark, tmp_path, monkeypatch):
    """Small splits and a known folder; the tables copied into files of several row groups."""
    monkeypatch.setattr(catalogue, "scratch", lambda _, name="table": f"file:{tmp_path}/shared/{name}-{uuid.uuid4().hex}")
    conf = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    for name in ("lineitem", "orders"):
        t = pq.read_table(f"{SMALL}/{name}.parquet")
        pq.write_table(t, str(tmp_path / f"{name}.parquet"), row_group_size=-(-len(t) // 6), compression="none")
    yield tmp_path
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shares(path):
    """Rows of each row group: as a task writes more than one only beyond 128 MB, of each task here."""
    md = pq.read_metadata(path)
    return [md.row_group(i).num_rows for i in range(md.num_row_groups)]


def test_log_actions_single_files_are_written_by_many_tasks(spark, split):
    found = sorted(map(tuple, catalogue.log_actions_by_kind(spark, str(split)).collect()))
    assert found == sorted(duckdb.sql(catalogue.ORACLE_SQL["log_actions_by_kind"]).fetchall())
    for version in (0, 1, 2, 4):
        (path,) = glob.glob(f"{split}/shared/table-*/{version}-*.parquet")
        own = shares(path)
        assert len(own) > 2 and max(own) < 0.6 * sum(own)
    assert sum(own) == pq.read_metadata(f"{SMALL}/lineitem.parquet").num_rows


@pytest.mark.parametrize("layout", ["hive", "directory", "filename"])
def test_foreign_files_are_written_by_many_tasks(spark, split, layout):
    files = catalogue._foreign(spark, str(split), layout)
    paths = glob.glob(f"{files.root[5:]}/**/*.parquet", recursive=True)
    rows = [pq.read_metadata(p).num_rows for p in paths]
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    assert sum(rows) == orders.count() and max(rows) < 0.2 * sum(rows)
    got = catalogue._imported(layout)(spark, str(split)).select(*orders.columns)
    assert got.exceptAll(orders).isEmpty() and orders.exceptAll(got).isEmpty()


def odd(spark, n=5000, tasks=7):
    """Nulls, nested and empty values, strings longer than a page's bounds; tasks without rows between those with."""
    df = spark.range(0, n, 1, tasks).where(f"id NOT BETWEEN {n // tasks} AND {3 * n // tasks}")
    return df.select("id", F.expr("if(id % 7 = 0, null, concat(repeat('é', cast(id % 90 as int)), id)) AS s"), F.expr("if(id % 3 = 0, null, array(id, null))").alias("a"),
                     F.expr("map(cast(id AS string), named_struct('x', id % 5, 'y', array('u')))").alias("m"), F.expr("cast(null AS double)").alias("none"),
                     F.expr("if(id % 11 = 0, double('nan'), id / 3)").alias("real"), F.expr("id % 2 = 0").alias("even"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("at"),
                     F.expr("cast(id AS decimal(30, 4))").alias("d"), F.expr("cast(id % 4 AS string)").alias("part"))


def same_rows(a, b):
    key = lambda df: sorted(map(repr, df.select("id", "s", "a", "m", "none", "real", "even", "at", "d", "part").collect()))
    return key(a) == key(b)


@pytest.mark.parametrize("by", [None, ["part"]])
def test_one_file_holds_what_many_do(spark, tmp_path, by):
    df = odd(spark)
    options = {"parquet.bloom.filter.enabled#id": "true", "parquet.page.size": "2048", "parquet.page.row.count.limit": "100"}
    many = LakeTable(spark, str(tmp_path / "many")).write(df, partition_by=by, options=options)
    one = LakeTable(spark, str(tmp_path / "one")).write(df, partition_by=by, options=options, one_file=True)
    assert len(one.file_urls()) == (4 if by else 1) and len(one.files().collect()) <= len(many.file_urls())
    assert same_rows(one.df(), df) and one.count() == df.count() == many.count()
    for where in ("id = 4321", "id BETWEEN 3000 AND 3010", "s IS NULL AND id > 4000", "d = 17", "real = 'NaN'", "id = -1"):
        assert same_rows(one.df(where), df.where(where)), where
    then = one.delete("id % 2 = 0").write(df.where("even"), one_file=True)
    assert same_rows(then.df(), df)
    if not by:
        (path,) = [u[5:] for u in one.file_urls()]
        assert len(shares(path)) > 2
        assert duckdb.sql(f"SELECT count(*), sum(id), count(s), sum(real) FILTER (NOT isnan(real)) FROM '{path}' WHERE id > 4000").fetchall() \
            == [tuple(df.where("id > 4000").agg(F.count("*"), F.sum("id"), F.count("s"), F.expr("sum(real) FILTER (WHERE NOT isnan(real))")).first())]
        assert pq.read_table(path).num_rows == one.count()


def test_empty_and_single_parts(spark, tmp_path):
    df = odd(spark)
    t = LakeTable(spark, str(tmp_path / "t")).write(df.where("false"), one_file=True)
    assert t.count() == 0 and t.file_urls() == []
    t = t.write(df.where("id = 3"), one_file=True)
    assert len(t.file_urls()) == 1 and same_rows(t.df(), df.where("id = 3"))


def test_streamed_parts_are_the_same_rows(spark, tmp_path):
    """What a store gets in which no file can be written in several places."""
    df = odd(spark)
    df.write.option("parquet.bloom.filter.enabled#id", "true").parquet(str(tmp_path / "p"))
    files = [f for f in Location.of(spark, str(tmp_path / "p")).files() if f[0].endswith(".parquet")]
    assert len(files) > 2
    joined._streamed(spark, files, to := Location.of(spark, str(tmp_path / "j.parquet")))
    got = spark.read.parquet(to.url)
    assert same_rows(got, df) and same_rows(got.where("id = 4321"), df.where("id = 4321"))


def test_files_of_different_schemas_are_refused(spark, tmp_path):
    paths = [str(tmp_path / f"{i}.parquet") for i in range(2)]
    pq.write_table(pa.table({"a": [1]}), paths[0])
    pq.write_table(pa.table({"b": [1]}), paths[1])
    files = [f for f in Location.of(spark, str(tmp_path)).files()]
    with pytest.raises(ValueError, match="schemas"):
        joined.join_files(spark, files, Location.of(spark, str(tmp_path / "j.parquet")))
