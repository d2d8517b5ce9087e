"""Whole evaluations, comparisons, sources and sinks."""

import gzip

import pytest
from pyspark.sql import functions as F

from tablegauge import EvaluationContext, compare_runs, compare_versions, evaluate, profile, register_metric
from tablegauge.operators.diff import choose_baselines, diff_summary
from tablegauge.operators.drilldown import page, search, violations
from tablegauge.operators.findings import MetricFrames, fixed_score, no_issues
from tablegauge.operators.column_stats import column_stats
from tablegauge.operators.profiling import worst_first
from tablegauge.operators.versions import add_version, next_versions, version_facts, with_root
from tablegauge.plans.evaluate import check_config, referenced_columns
from tablegauge.sources.csv_files import choose_types, read_csv, sniff, type_choices
from tablegauge.sources.run_store import RunStore
from tablegauge.sources.sinks import append_run, stored_issues
from tablegauge.sources.tables import preview, schema_listing

PEOPLE = [(i, f"p{i}@x.com" if i % 4 else "bad", 1000 + i, "Lead" if i % 5 else None) for i in range(40)]
CONFIG = {
    "metrics": [
        {"id": "completeness", "parameters": {"threshold": 0.95}},
        {"id": "uniqueness", "parameters": {"columns": ["id"]}},
        {"id": "syntactic_accuracy", "parameters": {"columns": [{"column": "mail", "expected_type": "email"}]}},
        {"id": "logical_consistency", "parameters": {"rules": [{"name": "pay", "expression": "pay > 1030"}]}},
        {"id": "outliers", "parameters": {"columns": ["pay"]}},
        {"id": "validity", "parameters": {}},
    ]
}


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id int, mail string, pay int, grade string")


@pytest.fixture(scope="module")
def first_run(people):
    return evaluate(people, CONFIG, EvaluationContext(id_columns=["id"], run_id=1, project_id=2))


def test_run_row(first_run):
    run = first_run.run.first()
    assert run["n_rows"] == 40 and run["status"] == "COMPLETED"
    assert run["new_issues"] == run["total_issues"] == first_run.issues.count()
    assert 0 <= run["quality_score"] <= 100
    assert first_run.skipped == {"validity": "no metric computes this"}


def test_outliers_do_not_enter_the_run(first_run):
    assert "outliers" in first_run.details
    assert first_run.issues.where("metric = 'outliers'").count() == 0


def test_fingerprints_are_sixteen_hex(first_run):
    assert first_run.issues.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).count() == 0


def test_second_run_is_all_recurrent(people, first_run):
    context = EvaluationContext(id_columns=["id"], baseline_issues=first_run.issues)
    run = evaluate(people, CONFIG, context).run.first()
    assert run["new_issues"] == 0 and run["fixed_issues"] == 0
    assert run["recurrent_issues"] == run["total_issues"]


def test_repaired_table_fixes_issues(people, first_run):
    better = people.withColumn("grade", F.lit("Lead")).withColumn("mail", F.lit("a@b.com"))
    context = EvaluationContext(id_columns=["id"], baseline_issues=first_run.issues)
    assert evaluate(better, CONFIG, context).run.first()["fixed_issues"] > 0


def test_registered_metric(spark, people):
    def always_half(df, params, context):
        return MetricFrames(fixed_score(spark, "half", 0.5), df.limit(0), no_issues(spark))

    register_metric("half", always_half)
    result = evaluate(people, {"metrics": [{"id": "half"}]})
    assert result.scores.first()["score"] == 0.5


def test_config_checks():
    with pytest.raises(ValueError):
        check_config({"metrics": []})
    with pytest.raises(ValueError):
        check_config({"metrics": [{"id": "nonsense"}]})
    with pytest.raises(ValueError):
        check_config({"metrics": [{"id": "completeness"}, {"id": "completeness"}]})


def test_referenced_columns(people):
    entries = [{"id": "a", "parameters": {"columns": ["pay"]}}, {"id": "b", "parameters": {"columns": [{"column": "mail"}]}}]
    assert referenced_columns(people, entries) == ["mail", "pay"]
    assert referenced_columns(people, [*entries, {"id": "c"}]) == people.columns


def test_null_patterns_reach_column_metrics(spark):
    data = spark.createDataFrame([("x",), ("N/A",)], "a string")
    config = {"metrics": [{"id": "completeness", "parameters": {"null_patterns": {"presets": ["na"]}}}]}
    assert evaluate(data, config).column_metrics.first()["n_nulls"] == 1


def test_bad_parameters_skip_one_metric(people):
    config = {"metrics": [
        {"id": "class_balance", "parameters": {"expected_distribution": {"grade": {"Lead": [1]}}}},
        {"id": "completeness"},
    ]}
    result = evaluate(people, config)
    assert "class_balance" in result.skipped and result.scores.count() == 1


def test_profile(people):
    result = profile(people, sensitive=["pay"])
    assert result.overview.first()["total_cells"] == 160
    stats = {r["column_name"]: r for r in result.statistics.collect()}
    assert stats["pay"]["mean"] is None and stats["pay"]["redacted"] and not stats["id"]["redacted"]
    assert result.type_summary.count() == 2
    result.frequency.unpersist()
    with pytest.raises(ValueError):
        profile(people, iqr_factor=11)


# ---- stored history -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark):
    datasets = spark.createDataFrame(
        [(1, None, 1, False, 10, 2, ["id", "a"]), (2, 1, 2, False, 12, 3, ["id", "a", "b"]), (3, 2, 3, True, 9, 2, ["id", "b"]),
         (4, None, 1, True, 1, 1, ["z"])],
        "dataset_id int, parent_dataset_id int, version int, is_latest boolean, row_count int, column_count int, columns array<string>",
    )
    runs = spark.createDataFrame(
        [(10, 1, 1, "COMPLETED", 70.0, 2, "2024-01-01", None), (11, 1, 2, "COMPLETED", 80.5, 3, "2024-01-02", None),
         (12, 1, 3, "FAILED", None, 0, None, 10), (13, 2, 4, "COMPLETED", 50.0, 0, "2024-01-03", None)],
        "run_id int, project_id int, dataset_id int, status string, quality_score double, total_issues int, completed_at string, baseline_run_id int",
    )
    issues = spark.createDataFrame(
        [(1, 10, "A", "x", "low", "1", 1), (2, 10, "B", "y", "low", "1", 1), (3, 11, "B", "y", "high", "2", 4),
         (4, 11, None, "n", "low", "1", 1), (5, 11, "C", "z", "low", "1", 1)],
        "issue_id int, run_id int, fingerprint string, description string, severity string, actual_value string, affected_row_count int",
    )
    return datasets, runs, issues


def test_versions(stored):
    rooted = with_root(stored[0])
    facts = {r["dataset_id"]: r for r in version_facts(rooted).collect()}
    assert facts[3]["root_id"] == 1 and facts[3]["version_count"] == 3 and facts[3]["previous_id"] == 2
    assert facts[1]["next_count"] == 1 and facts[1]["is_root"]
    assert [r["dataset_id"] for r in next_versions(stored[0], 1).collect()] == [2]
    after = add_version(rooted, 3, 9)
    chain = {r["dataset_id"]: r for r in after.where("root_id = 1").collect()}
    assert chain[9]["version"] == 4 and [k for k, r in chain.items() if r["is_latest"]] == [9]


def test_compare_versions(stored):
    compared = compare_versions(*stored, 1, 2)
    delta = compared.deltas.first()
    assert (delta["rows_diff"], delta["columns_diff"], delta["quality_score_diff"], delta["issues_diff"]) == (2, 1, 10.5, 1)
    assert tuple(compared.schema.first()) == (["b"], [])
    found = {(r["status"], r["issue_id"]) for r in compared.issues.collect()}
    assert found == {("resolved", 1), ("common", 3), ("new", 4), ("new", 5)}
    with pytest.raises(ValueError):
        compare_versions(*stored, 1, 4)


def test_baselines_and_diff(stored):
    _, runs, issues = stored
    chosen = {r["run_id"]: r["chosen_baseline_id"] for r in choose_baselines(runs).collect()}
    assert chosen == {10: 11, 11: 10, 12: 10, 13: None}
    summary = {r["run_id"]: r for r in diff_summary(issues, choose_baselines(runs)).collect()}
    assert (summary[11]["new_issues"], summary[11]["recurrent_issues"], summary[11]["fixed_issues"]) == (2, 1, 1)
    assert (summary[12]["fixed_issues"], summary[13]["has_baseline"]) == (2, False)


def test_compare_runs(spark, stored):
    scores = spark.createDataFrame(
        [(10, "completeness", 0.5), (11, "completeness", 0.75), (10, "outliers", 0.9), (11, "outliers", None)],
        "run_id int, metric string, score double",
    )
    compared = compare_runs(stored[1], scores, 10, 11)
    assert [tuple(r) for r in compared.metrics.collect()] == [("completeness", 0.5, 0.75, 0.25, "decline")]
    assert compared.overall.first()["overall_trend"] == "decline"


def test_run_tables(tmp_path, spark, first_run):
    run = first_run.run.first()
    kept = stored_issues(first_run.issues, run["run_id"], run["project_id"], 40)
    append_run(first_run.run, kept, str(tmp_path / "out"))
    append_run(first_run.run, kept, str(tmp_path / "out"))
    back = RunStore(spark, str(tmp_path / "out")).issues()
    assert back.count() == first_run.issues.count() > 0
    assert back.where("affected_rows_pct > 1 OR severity NOT IN ('critical','major','minor','info')").count() == 0


# ---- drill-down -----------------------------------------------------------------------------


def test_violation_pages(people):
    check = {"metric": "logical_consistency", "rule": CONFIG["metrics"][3]["parameters"]["rules"][0]}
    rows, info = violations(people, check, ["id"], number=2, size=4, sensitive=["mail"])
    assert [r["id"] for r in rows.collect()] == [35, 36, 37, 38]
    assert rows.first()["mail"] == "***"
    facts = info.first()
    assert (facts["total"], facts["total_pages"], facts["has_next"], facts["has_prev"]) == (9, 3, True, True)


def test_masked_column_hides_the_offending_text(people):
    check = {"metric": "syntactic_accuracy", "column": "mail", "pattern": "^[^@]+@"}
    rows, _ = violations(people, check, ["id"], sensitive=["mail"])
    assert rows.first()["__invalid_value"] == "***"


def test_search_is_literal_unless_asked(people):
    assert search(people, "p1.").count() == 0
    assert search(people, "p1.@", regex=True).count() > 0
    assert page(people, ["id"], size=3, after=[36]).count() == 3


# ---- sources --------------------------------------------------------------------------------


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    lines = [sep.join(("id", "name", "code", "x"))] + [sep.join((str(i), f"n{i}", f"0{i}", "" if i % 2 else "1.5")) for i in range(1, 9)]
    df = read_csv(spark, write(tmp_path, "t.csv", "\n".join(lines).encode()))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "code": "string", "x": "double"}
    assert df.count() == 8 and df.where("x IS NULL").count() == 4


def test_encodings_and_quotes(spark, tmp_path):
    latin = write(tmp_path, "l.csv", "id;ciudad\n1;Málaga\n2;5 € en Cádiz\n".encode("cp1252"))
    assert [r["ciudad"] for r in read_csv(spark, latin).orderBy("id").collect()] == ["Málaga", "5 € en Cádiz"]
    bom = write(tmp_path, "b.csv", b"\xef\xbb\xbfid,t\n1,\"a \"\"q\"\", and\nmore\"\n\n2,NA\n")
    df = read_csv(spark, bom)
    assert df.columns == ["id", "t"]
    assert [r["t"] for r in df.orderBy("id").collect()] == ['a "q", and\nmore', None]


def test_gzip(spark, tmp_path):
    path = write(tmp_path, "z.csv.gz", gzip.compress(b"a,b\n1,2\n3,4\n"))
    assert read_csv(spark, path).count() == 2


def test_unusable_files(spark, tmp_path):
    for name, data in (("e.csv", b""), ("x.csv", b"PK\x03\x04zzzz"), ("g.csv", gzip.compress(b"a,b\n1,2\n"))):
        with pytest.raises(ValueError):
            sniff(spark, write(tmp_path, name, data))


def test_type_choices(spark):
    rows = [("1", "1", "True", "5d", "001", None), ("NA", "2.5", "False", "6", "002", None), ("-3", "1e3", "NaN", "7", "3", None)]
    text = spark.createDataFrame(rows, "i string, d string, b string, t string, z string, n string")
    assert type_choices(text) == {"i": "bigint", "d": "double", "b": "boolean", "t": "string", "z": "string", "n": "string"}
    assert type_choices(text, leading_zeros_are_text=False)["z"] == "bigint"
    assert choose_types(text).where("i IS NULL").count() == 1


def test_worst_columns_come_first(people):
    rows = worst_first(column_stats(people), "completeness").collect()
    assert rows[0]["column_name"] == "grade" and rows[0]["n_missing"] == 8


def test_listing_and_preview(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id int, x double")
    listed = {r["name"]: (r["type"], r["nullable"]) for r in schema_listing(df).collect()}
    assert listed == {"id": ("int", False), "x": ("double", True)}
    assert [r["x"] for r in preview(df, ["id"], rows=2).collect()] == [None, 1.0]
