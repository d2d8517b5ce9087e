"""The run store: retries, failed writes, superseded runs, compaction and files a project."""

import datetime as dt
import glob

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablegauge.queries.source_queries import run_store_compaction
from tablegauge.sources.run_store import RunStore

RUNS, ISSUES = "run_id int, project_id int, status string", "run_id int, project_id int, kind string"


@pytest.fixture
def make(spark, tmp_path):
    def frames(runs, issues):
        return spark.createDataFrame(runs, RUNS), spark.createDataFrame(issues, ISSUES)

    return RunStore(spark, str(tmp_path / "store")), frames


def test_retry_and_replacement(make):
    store, frames = make
    assert store.commits().collect() == []
    with pytest.raises(ValueError, match="no commit"):
        store.runs()
    first = frames([(1, 1, "a"), (2, 1, "a"), (3, None, "a")], [(1, 1, "x"), (1, 1, "x"), (2, 1, "y"), (3, None, "z")])
    for _ in range(2):
        assert store.write(*first, "one") == "one"
    assert store.runs().count() == 3
    assert store.issues().count() == 4
    store.write(*frames([(2, 5, "b")], []), "two")
    assert sorted(map(tuple, store.runs().where("run_id < 3").collect())) == [(1, "a", 1), (2, "b", 5)]
    assert sorted(r.kind for r in store.issues().collect()) == ["x", "x", "z"]
    store.write(*frames([(1, 1, "c")], [(1, 1, "w")]))
    assert sorted(r.kind for r in store.issues().collect()) == ["w", "z"]


def test_failed_writes_do_not_show(spark, make):
    store, frames = make
    store.write(*frames([(1, 1, "a")], [(1, 1, "x")]), "one")
    broken = spark.createDataFrame([(1, 1, "b"), (2, 1, "b")], RUNS).withColumn("status", F.when(F.col("run_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("status")).cast("string"))
    with pytest.raises(PySparkException):
        store.write(broken, frames([], [])[1], "two")
    bad_issues = frames([], [(1, 1, "y")])[1].withColumn("kind", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(PySparkException):
        store.write(frames([(1, 1, "b")], [])[0], bad_issues, "two")
    assert glob.glob(f"{store.folder}/runs/commit=two/*/*.parquet")
    assert [tuple(r) for r in store.runs().collect()] == [(1, "a", 1)] and store.issues().first().kind == "x"
    store.write(*frames([(1, 1, "b"), (4, 1, "b")], [(4, 1, "v")]), "two")
    assert sorted(map(tuple, store.runs().collect())) == [(1, "b", 1), (4, "b", 1)]
    assert [r.kind for r in store.issues().collect()] == ["v"]


def test_what_is_refused(make):
    store, frames = make
    with pytest.raises(ValueError, match="twice"):
        store.write(*frames([(1, 1, "a"), (1, 2, "a")], []))
    with pytest.raises(ValueError, match="no row, of run 9"):
        store.write(*frames([(1, 1, "a")], [(9, 1, "x")]))
    with pytest.raises(ValueError, match="commit id"):
        store.write(*frames([], []), "../x")
    with pytest.raises(ValueError, match="need run_id"):
        store.write(frames([], [])[0].drop("project_id"), frames([], [])[1])
    with pytest.raises(ValueError, match="not staged"):
        store.publish("other")
    store.write(*frames([(1, 1, "a")], []), "one")
    with pytest.raises(ValueError, match="cannot change"):
        store.stage(*frames([(1, 1, "b")], []), "one")


def test_compaction_and_new_columns(spark, make):
    store, frames = make
    for i in range(4):
        store.write(*frames([(j, j % 2, str(i)) for j in range(i, 40)], [(j, j % 2, f"{i}-{j}") for j in range(i, 40)]))
    wider = frames([(39, 1, "new")], [(39, 1, "n")])
    store.write(wider[0].withColumn("extra", F.lit(7)), wider[1])
    before = sorted(map(tuple, store.runs().collect()), key=str), sorted(map(tuple, store.issues().collect()))
    assert dict(store.runs().dtypes)["extra"] == "int"
    store.compact()
    assert store.commits().count() == 1
    assert (sorted(map(tuple, store.runs().collect()), key=str), sorted(map(tuple, store.issues().collect()))) == before
    assert store.runs().where("extra = 7").count() == 1 and store.runs().count() == 40


def test_files_a_project_follow_its_size(spark, tmp_path):
    """Many tasks hold rows of every project: a small one still gets one file, a hot one a few."""
    runs = spark.range(5000, numPartitions=20).select(F.col("id").alias("run_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 10).alias("project_id"))
    store = RunStore(spark, str(tmp_path / "store"))
    store.write(runs, runs.withColumn("kind", F.sha2(F.col("run_id").cast("string"), 256)))
    for table in ("runs", "issues"):
        files = [f.split("project_id=")[1].split("/")[0] for f in glob.glob(f"{store.folder}/{table}/*/*/*.parquet")]
        assert len(files) == len(set(files)) == 10
    assert store.issues().count() == 5000


def test_id_sums_beyond_a_long(spark, tmp_path):
    """the ids of a project may add up to more than a long holds; smaller sums stay long."""
    orders = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    items = (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    )
    day = dt.datetime(2024, 1, 1)
    for at, kind in ((600_000_001, "decimal(30,0)"), (1, "bigint")):
        keys = [at, at + 2, at + 4]
        spark.createDataFrame([(k, 25, "F", 1.0, day, "x") for k in keys], orders).write.parquet(f"{tmp_path}/{at}/orders.parquet")
        spark.createDataFrame([(1,)], "p_partkey bigint").write.parquet(f"{tmp_path}/{at}/part.parquet")
        rows = [(k, 1, 1, 1, 5.0, 1.0, 0.0, 0.0, "A", "F", day) for k in keys]
        spark.createDataFrame(rows, items).write.parquet(f"{tmp_path}/{at}/lineitem.parquet")
        found = run_store_compaction(spark, f"{tmp_path}/{at}")
        assert dict(found.dtypes)["id_sum"] == kind
        row = found.first()
        assert (row.project_id, row.n_issues, row.n_runs, int(row.id_sum)) == (0, 3, 3, sum(((k * 100000 + 1) * 10000 + 1) * 10 + 1 for k in keys))
