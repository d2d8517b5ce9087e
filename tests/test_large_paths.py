"""The ways of large tables, forced on small ones and compared with brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablegauge.operators.column_stats import CENTRE, column_stats, shape
from tablegauge.operators.correlation import pearson, spearman
from tablegauge.operators.duplicates import duplicate_rows
from tablegauge.operators.frequency import top_values, value_frequency
from tablegauge.operators.histogram import histogram
from tablegauge.operators.lineage import follow_links
from tablegauge.operators.quantiles import quantiles
from tablegauge.operators.versions import compare_issues


def skewed(n=3000, seed=3):
    """A third of the values are one hot value; some are missing."""
    rng = np.random.default_rng(seed)
    hot = np.where(rng.random(n) < 0.34, 7.0, np.round(rng.lognormal(3, 2, n), 3))
    other = np.where(rng.random(n) < 0.4, -1.0, rng.integers(-50, 50, n).astype(float))
    gaps = np.where(rng.random(n) < 0.1, np.nan, hot * 2 + rng.normal(0, 50, n))
    return pd.DataFrame({"hot": hot, "other": other, "gaps": gaps})


@pytest.fixture(scope="module")
def data(spark):
    pdf = skewed()
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


@pytest.mark.parametrize("limit, steps", [(10**6, 1000), (200, 50), (0, 100)])
def test_quantiles(data, limit, steps):
    pdf, df = data
    probabilities = (0.0, 0.25, 0.34, 0.5, 0.999, 1.0)
    got = {(r[0], r[1]): r[2] for r in quantiles(df, None, probabilities, limit, steps).collect()}
    for name in pdf:
        for p in probabilities:
            assert got[name, p] == pytest.approx(pdf[name].quantile(p), rel=1e-12, abs=1e-12)


def test_spearman(data):
    pdf, df = data
    expected = pdf.corr(method="spearman")
    for a, b, value in spearman(df).collect():
        assert value == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_pearson_and_constant_columns(spark, data):
    pdf, df = data
    for a, b, value in pearson(df).collect():
        assert value == pytest.approx(pdf.corr().loc[a, b], abs=1e-9)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert pearson(flat).first()["coefficient"] is None
    assert spearman(flat).first()["coefficient"] is None


def test_shape(data):
    pdf, df = data
    stats = column_stats(df, None, CENTRE)
    for row in shape(df, list(pdf), stats).collect():
        values = pdf[row["column_name"]].dropna()
        assert row["std"] == pytest.approx(values.std())
        assert row["skewness"] == pytest.approx(values.skew())
        assert row["kurtosis"] == pytest.approx(values.kurtosis())


def test_known_statistics(spark):
    values = [28500, 29000, 30000, 31000, 31500, 32000, 32500, 33000, 35000, 150000]
    df = spark.createDataFrame([(v,) for v in values], "x int")
    row = shape(df, ["x"], column_stats(df, None, CENTRE)).first()
    assert row["std"] == pytest.approx(37557.548435)
    assert row["skewness"] == pytest.approx(3.146728, abs=1e-6)
    assert row["kurtosis"] == pytest.approx(9.927731, abs=1e-6)


@pytest.mark.parametrize("bins", [1, 7, 10, 30])
def test_histogram_equals_numpy(data, bins):
    pdf, df = data
    got = histogram(df, list(pdf), bins).toPandas()
    for name in pdf:
        counts, edges = np.histogram(pdf[name].dropna(), bins)
        rows = got[got.column_name == name].sort_values("bin")
        assert rows.cnt.tolist() == counts.tolist()
        assert rows.bin_start.tolist() == pytest.approx(edges[:-1].tolist())


def test_constant_histogram(spark):
    got = histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), ["x"], 10).orderBy("bin").collect()
    counts, edges = np.histogram([3.0] * 4, 10)
    assert [r["cnt"] for r in got] == counts.tolist()


def chains(n, seed):
    rng = random.Random(seed)
    return {i: (rng.randrange(i) if i and rng.random() < 0.95 else None) for i in range(n)}


def walk(parents, node):
    seen = []
    while parents.get(node) is not None and parents[node] in parents and node not in seen:
        seen.append(node)
        node = parents[node]
    return node


@pytest.mark.parametrize(
    "parents",
    [
        chains(60, 1),
        {i: i - 1 if i else None for i in range(70)},
        {i: 0 if i else None for i in range(40)},
        {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: None, 7: 6, 8: 8, 9: 8},
        {1: 99, 2: 1},
    ],
    ids=["random", "deep", "hub", "cycles", "dangling"],
)
def test_follow_links(spark, parents):
    links = spark.createDataFrame(list(parents.items()), "id int, target int")
    got = {r["id"]: r["end"] for r in follow_links(links).collect()}
    assert got == {node: walk(parents, node) for node in parents}


def test_paths_join_labels_from_the_end(spark):
    links = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c")], "id int, target int, label string")
    got = {r["id"]: r["path"] for r in follow_links(links, "label").collect()}
    assert got == {1: "a", 2: "ab", 3: "abc"}


def test_hot_duplicate_group(spark):
    rows = [("h", None, i) for i in range(500)] + [("a", 1, 900), ("a", 1, 901), ("b", 2, 902)]
    df = spark.createDataFrame(rows, "x string, y int, id int")
    got = duplicate_rows(df, ["x", "y"], ["id"]).orderBy("group_id", "copy").collect()
    assert [(r["group_id"], r["cnt"], r["copy"]) for r in got] == [
        (1, 2, 1), (1, 2, 2), (2, 500, 1), (2, 500, 2), (2, 500, 3), (2, 500, 4), (2, 500, 5)
    ]


def test_issue_matching_falls_back_to_descriptions(spark):
    schema = "issue_id int, fingerprint string, description string, severity string, actual_value string, affected_row_count int"
    before = spark.createDataFrame(
        [(1, "f1", "x", "high", "1", 5), (2, None, "same text", "low", "2", 1), (3, "f3", "gone", "low", "3", 1)], schema
    )
    after = spark.createDataFrame(
        [(4, "f1", "y", "low", "9", 2), (5, "", "same text", "low", "2", 1), (6, "f9", "same text", "low", "2", 1)], schema
    )
    got = {(r["status"], r["issue_id"]) for r in compare_issues(before, after).collect()}
    assert got == {("common", 4), ("common", 5), ("new", 6), ("resolved", 3)}


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_keep_groups_inside_tasks(data):
    _, df = data
    top = plan(top_values(value_frequency(df), 5))
    assert "WindowGroupLimit" in top and "Partial" in top
    for frame in (top_values(value_frequency(df), 5), histogram(df, ["hot"]), quantiles(df), duplicate_rows(df)):
        text = plan(frame)
        assert "EvalPython" not in text and "InPandas" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_scan_reads_only_what_is_asked(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.lit("x" * 10).alias("a"), F.lit(1.0).alias("b")).write.parquet(path)
    text = plan(histogram(spark.read.parquet(path), ["b"]))
    assert "ReadSchema: struct<b:double>" in text and "a:string" not in text
