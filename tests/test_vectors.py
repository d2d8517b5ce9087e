"""Small frames with known answers for every metric."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablegauge.functions.columns import semantic_type
from tablegauge.functions.fingerprints import (
    balance_fingerprint,
    column_fingerprint,
    diversity_fingerprint,
    duplicate_rows_fingerprint,
    expected_unique_fingerprint,
    fingerprint,
    outlier_fingerprint,
    rule_fingerprint,
    staleness_fingerprint,
    syntactic_fingerprint,
    variability_fingerprint,
)
from tablegauge.functions.patterns import anchored, apply_null_patterns, is_valid_pattern, matches
from tablegauge.functions.scalars import age_text, float_text, integral_text, to_timestamp
from tablegauge.functions.severity import severity, variability_severity
from tablegauge.operators.balance import ClassBalance
from tablegauge.operators.completeness import Completeness
from tablegauge.operators.currentness import Currentness
from tablegauge.operators.diversity import Diversity
from tablegauge.operators.findings import Context
from tablegauge.operators.outliers import Outliers
from tablegauge.operators.rules import LogicalConsistency, forbidden_word, prepare_rules
from tablegauge.operators.scoring import gate_status, quality_score, severity_counts
from tablegauge.operators.syntax import SyntacticAccuracy
from tablegauge.operators.uniqueness import Uniqueness


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def score(result):
    return result.score.first()["score"]


def issues(result):
    return [row.asDict() for row in result.issues.collect()]


def value_of(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# ---- completeness ---------------------------------------------------------------------------


def test_complete_frame(spark):
    result = Completeness().run(frame(spark, "a int, b string", [(1, "x"), (2, "y"), (3, "z")]))
    assert score(result) == 1.0 and issues(result) == []


def test_half_missing(spark):
    result = Completeness().run(frame(spark, "a int", [(1,), (None,), (2,), (None,)]))
    assert score(result) == 0.5
    assert {i["column_name"] for i in issues(result)} == {"_dataset_", "a"}


def test_chosen_columns_only(spark):
    data = frame(spark, "important int, other int", [(1, None), (2, None), (3, None)])
    result = Completeness().run(data, {"columns": ["important"]})
    assert score(result) == 1.0 and issues(result) == []


def test_unknown_columns_are_complete(spark):
    assert score(Completeness().run(frame(spark, "a int", [(None,)]), {"columns": ["zzz"]})) == 1.0


def test_null_patterns_count_as_missing(spark):
    data = frame(spark, "a string", [("1",), ("N/A",), ("null",), ("2",), ("-",)])
    params = {"null_patterns": {"presets": ["na", "null_word", "dash"]}}
    assert score(Completeness().run(data, params)) == pytest.approx(0.4)


def test_bad_null_pattern_changes_nothing(spark):
    data = frame(spark, "a string", [("x",), ("y",)])
    assert apply_null_patterns(data, {"custom": ["(unclosed"]}).where("a IS NULL").count() == 0


def test_nan_is_missing(spark):
    assert score(Completeness().run(frame(spark, "a double", [(1.0,), (float("nan"),)]))) == 0.5


def test_rows_missing_any_problem_column(spark):
    data = frame(spark, "a int, b int, c int", [(None, 1, 1), (1, None, 1), (None, None, 1), (1, 1, 1)])
    dataset = [i for i in issues(Completeness().run(data)) if i["column_name"] == "_dataset_"]
    assert dataset[0]["affected_row_count"] == 3


# ---- uniqueness -----------------------------------------------------------------------------


def test_one_distinct_row(spark):
    result = Uniqueness().run(frame(spark, "a int, b string", [(1, "x")] * 20))
    assert score(result) == pytest.approx(1 / 20)
    assert "duplicate_rows" in {i["issue_type"] for i in issues(result)}


def test_expected_unique(spark):
    data = frame(spark, "user_id int, n int", [(k, i) for i, k in enumerate([1, 2, 2, 3, 3, 3])])
    found = [
        i
        for i in issues(Uniqueness().run(data, {"columns": ["user_id"], "threshold": 1.0}))
        if i["issue_type"] == "non_unique_identifier"
    ]
    assert len(found) == 1 and found[0]["details"]["duplicate_count"] == "3"


def test_low_variability(spark):
    data = frame(spark, "customer_id int, n int", [(1, i) for i in range(14)] + [(2, 99)])
    found = [i for i in issues(Uniqueness().run(data)) if i["issue_type"] == "low_variability"]
    assert [i["column_name"] for i in found] == ["customer_id"]


def test_duplicate_sample_is_masked(spark):
    data = frame(spark, "email string, name string", [("a@b.c", "Ann")] * 6)
    found = [
        i
        for i in issues(Uniqueness().run(data, context=Context(sensitive=["email"])))
        if i["issue_type"] == "duplicate_rows"
    ]
    assert found[0]["sample"] == ['{"email":"***","name":"Ann"}'] * 5
    assert found[0]["affected_row_count"] == 5


def test_long_texts_are_compared_whole(spark):
    text = "x" * 5000
    data = frame(spark, "t string", [(text + "a",), (text + "b",), (text + "a",)])
    assert score(Uniqueness().run(data)) == pytest.approx(2 / 3)


# ---- syntactic accuracy ---------------------------------------------------------------------


def checks(column, kind="", pattern=""):
    entry = {"column": column, "expected_type": kind, "pattern": pattern}
    return {"columns": [entry], "auto_detect_types": False}


def test_email(spark):
    data = frame(spark, "m string", [("a@b.com",), ("bad",), ("c@d.org",), ("also bad",)])
    result = SyntacticAccuracy().run(data, checks("m", "email"))
    assert score(result) == 0.5 and issues(result)[0]["sample"] == ["also bad", "bad"]


def test_custom_pattern(spark):
    data = frame(spark, "c string", [("AB-1234",), ("XY-5678",), ("bad",)])
    result = SyntacticAccuracy().run(data, {"custom_patterns": {"c": r"^[A-Z]{2}-\d{4}$"}, "auto_detect_types": False})
    assert score(result) == pytest.approx(2 / 3) and len(issues(result)) == 1


def test_whole_doubles_lose_their_point(spark):
    data = frame(spark, "t double", [(658892118.0,), (612345678.0,), (None,)])
    assert score(SyntacticAccuracy().run(data, checks("t", "phone_es"))) == 1.0


def test_mixed_format_is_not_checked(spark):
    result = SyntacticAccuracy().run(frame(spark, "z string", [(str(10000 + i),) for i in range(20)]))
    assert score(result) == 1.0
    assert [i["issue_type"] for i in issues(result)] == ["mixed_format"]


def test_detected_format_is_checked(spark):
    rows = [(f"u{i}@x.com",) for i in range(9)] + [("nope",)]
    result = SyntacticAccuracy().run(frame(spark, "mail string", rows))
    assert score(result) == pytest.approx(0.9)


def test_stored_pattern_overrides_builtin(spark):
    patterns = frame(
        spark, "owner_id int, key string, regex string", [(None, "email", "^sys$"), (4, "email", "^own$"), (5, "email", "^x$")]
    )
    data = frame(spark, "m string", [("own",), ("sys",)])
    context = Context(patterns=patterns, owner_id=4)
    assert score(SyntacticAccuracy().run(data, checks("m", "email"), context)) == 0.5


def test_patterns_match_from_the_start(spark):
    assert value_of(spark, matches(F.lit("abc"), "b")) is False
    assert value_of(spark, matches(F.lit("abc"), "a")) is True
    assert value_of(spark, matches(F.lit("٣"), r"\d$")) is True
    assert anchored("(?P<n>a)(?P=n)") == r"(?U)^(?:(?<n>a)\k<n>)"
    assert not is_valid_pattern(spark, "(a")


# ---- rules ----------------------------------------------------------------------------------


def test_violation_rule(spark):
    data = frame(spark, "price double, discount double", [(10.0, 5.0), (20.0, 25.0), (30.0, 100.0)])
    rule = {"name": "r", "expression": "discount >= price"}
    result = LogicalConsistency().run(data, {"rules": [rule]})
    assert score(result) == pytest.approx(1 / 3) and len(issues(result)) == 1


def test_if_then_counts_its_scope(spark):
    rows = [("ES", "28001"), ("ES", "bad"), ("ES", "x"), ("FR", "zz"), ("FR", "75001")]
    data = frame(spark, "country string, postal_code string", rows)
    rule = {"name": "r", "type": "if_then", "condition": "country == 'ES'", "assertion": r"postal_code rlike '^[0-9]{5}$'"}
    result = LogicalConsistency().run(data, {"rules": [rule]})
    assert score(result) == pytest.approx(1 / 3)
    assert result.columns.first()["n_scope"] == 3


def test_blocked_rule(spark):
    result = LogicalConsistency().run(frame(spark, "a int", [(1,)]), {"rules": [{"name": "r", "expression": "__import__('os')"}]})
    assert [i["severity"] for i in issues(result)] == ["high"] and score(result) == 1.0


def test_words_inside_names_and_texts_are_allowed():
    assert forbidden_word("importe > 1 and opening = 'open'") is None
    assert forbidden_word("open > 1") == "open"
    assert forbidden_word("exec('a', 'b')") == "exec"


def test_failing_rule_leaves_the_mean(spark):
    rules = [{"name": "bad", "expression": "nope > 1"}, {"name": "good", "expression": "a > 1"}]
    result = LogicalConsistency().run(frame(spark, "a int", [(1,), (2,)]), {"rules": rules})
    assert score(result) == 0.5
    assert [r["error"] is None for r in result.columns.orderBy("rule_index").collect()] == [False, True]


def test_rule_columns(spark):
    data = frame(spark, "a int, b string, upper int", [(1, "x", 1)])
    rule = prepare_rules(data, [{"name": "r", "expression": "a > 1 and b = 'a' and upper(b) = 'B'"}])[0]
    assert rule.columns == ["a", "b"]


def test_no_rules_no_score(spark):
    assert score(LogicalConsistency().run(frame(spark, "a int", [(1,)]))) is None


# ---- class balance --------------------------------------------------------------------------


def labels(spark, **counts):
    return frame(spark, "label string", [(k,) for k, n in counts.items() for _ in range(n)])


def test_even_classes(spark):
    result = ClassBalance().run(labels(spark, a=50, b=50), {"columns": ["label"]})
    assert score(result) == pytest.approx(1.0) and issues(result) == []


def test_detected_only_has_no_score(spark):
    result = ClassBalance().run(labels(spark, a=95, b=5))
    assert score(result) is None and result.columns.count() == 1


def test_expected_distribution(spark):
    expected = {"label": {"A": [70, 85], "B": [15, 25]}}
    result = ClassBalance().run(labels(spark, A=80, B=20), {"expected_distribution": expected})
    assert not [i for i in issues(result) if i["rule_key"] == "balance_distribution_deviation"]
    assert score(result) == pytest.approx(0.5 * 0.7219 + 0.5, abs=1e-4)


def test_imbalance_issue_levels(spark):
    result = ClassBalance().run(labels(spark, a=97, b=3), {"columns": ["label"]})
    by_rule = {i["rule_key"]: i["severity"] for i in issues(result)}
    assert by_rule == {"balance_dominant_class": "high", "balance_minority_class": "low"}
    assert result.columns.first()["entropy"] == pytest.approx(0.1944, abs=1e-4)


def test_malformed_range_is_rejected(spark):
    with pytest.raises(ValueError):
        ClassBalance().run(labels(spark, a=1), {"expected_distribution": {"label": {"a": [1]}}})


def test_one_class_has_index_zero(spark):
    result = ClassBalance().run(labels(spark, a=30), {"columns": ["label"]})
    assert result.columns.first()["balance_index"] == 0.0


# ---- currentness ----------------------------------------------------------------------------

NOW = dt.datetime(2026, 3, 31, 12, 0, 0)


def dates(spark, *days_ago):
    return frame(spark, "ts timestamp", [(NOW - dt.timedelta(days=d),) for d in days_ago])


@pytest.mark.parametrize(
    "days, expected, level",
    [((0, 1), 1.0, None), ((99,), 1 - 69 / 90, "high"), ((120, 130), 0.0, "high"), ((1825,) * 10, 0.0, "critical")],
)
def test_freshness(spark, days, expected, level):
    result = Currentness().run(dates(spark, *days), {"staleness_threshold_days": 30}, Context(as_of=NOW))
    assert score(result) == pytest.approx(expected)
    assert [i["severity"] for i in issues(result)] == ([level] if level else [])


def test_no_dates(spark):
    data = frame(spark, "name string, age int", [("Ann", 3)])
    assert score(Currentness().run(data, {"columns": ["age"]}, Context(as_of=NOW))) == 1.0


def test_low_parse_rate(spark):
    data = frame(spark, "d string", [("2026-03-30",)] * 7 + [("soon",)] * 5)
    found = issues(Currentness().run(data, {}, Context(as_of=NOW)))
    assert [(i["rule_key"], i["severity"]) for i in found] == [("parse_quality_check", "low")]


def test_sensitive_dates_are_masked(spark):
    context = Context(as_of=NOW, sensitive=["ts"])
    found = issues(Currentness().run(dates(spark, 400), {}, context))
    assert found[0]["details"]["max_date"] == "***"


# ---- diversity ------------------------------------------------------------------------------


def countries(spark, *names):
    return frame(spark, "country string", [(n,) for n in names for _ in range(10)])


@pytest.mark.parametrize("present, expected", [(("ES", "FR", "DE"), 1.0), (("ES", "FR"), 2 / 3)])
def test_expected_values(spark, present, expected):
    params = {"columns": {"country": {"expected_values": ["ES", "FR", "DE"], "min_representation": 0.1}}}
    result = Diversity().run(countries(spark, *present), params)
    assert score(result) == pytest.approx(expected)
    assert len(issues(result)) == 3 - len(present)


def test_underrepresented_counts_half(spark):
    data = frame(spark, "c string", [("a",)] * 99 + [("b",)])
    params = {"columns": {"c": {"expected_values": ["a", "b"], "min_representation": 0.05}}}
    result = Diversity().run(data, params)
    assert score(result) == 0.75 and issues(result)[0]["severity"] == "medium"


def test_numeric_range(spark):
    data = frame(spark, "x double", [(i * 9 / 99,) for i in range(100)])
    params = {"columns": {"x": {"type": "numeric", "expected_range": [0, 100], "num_bins": 10}}}
    result = Diversity().run(data, params)
    assert score(result) == pytest.approx(0.1)
    assert [i["severity"] for i in issues(result)] == ["critical"]


def test_numeric_values_are_clipped(spark):
    data = frame(spark, "x string", [("-5",), ("200",), ("bad",), ("100",)])
    params = {"columns": {"x": {"type": "numeric", "expected_range": [0, 100], "num_bins": 4}}}
    assert score(Diversity().run(data, params)) == 0.5


def test_nothing_expected(spark):
    assert score(Diversity().run(countries(spark, "ES"))) is None


# ---- outliers -------------------------------------------------------------------------------


def test_iqr_outlier(spark):
    data = frame(spark, "x int", [(i,) for i in range(1, 11)] + [(1000,)])
    result = Outliers().run(data)
    assert result.columns.first()["outlier_count"] == 1 and score(result) is None


def test_zscore_outlier(spark):
    data = frame(spark, "x int", [(i,) for i in range(100)] + [(10000,)])
    assert len(issues(Outliers().run(data, {"method": "zscore", "factor": 3}))) == 1


def test_constant_column_has_no_zscore_outlier(spark):
    data = frame(spark, "x int", [(5,)] * 30)
    assert Outliers().run(data, {"method": "zscore"}).columns.first()["outlier_count"] == 0


def test_sensitive_outliers_lose_their_statistics(spark):
    data = frame(spark, "x int", [(i,) for i in range(1, 11)] + [(1000,)])
    result = Outliers().run(data, context=Context(sensitive=["x"]))
    row = result.columns.first()
    assert row["q1"] is None and row["max"] is None and row["outlier_count"] == 1
    assert issues(result)[0]["sample"] == ["***"]


# ---- severity, score, gate ------------------------------------------------------------------


@pytest.mark.parametrize(
    "value, threshold, expected",
    [(0.95, 0.95, "low"), (0.49, 0.95, "critical"), (0.69, 0.95, "high"), (0.79, 0.95, "high"),
     (0.85, 0.95, "medium"), (0.90, 0.95, "low"), (0.93, 0.95, "low")],
)
def test_ratio_severity(spark, value, threshold, expected):
    assert value_of(spark, severity("ratio", F.lit(value), threshold)) == expected


def test_other_scales(spark):
    assert value_of(spark, severity("outliers", F.lit(0.1))) == "high"
    assert value_of(spark, severity("class_balance", F.lit(0.99))) == "critical"
    assert value_of(spark, severity("diversity", F.lit(0.4), 0.6)) == "high"
    assert value_of(spark, severity("currentness_ratio", F.lit(2.9))) == "medium"
    assert value_of(spark, severity("unknown", F.lit(2.9))) == "medium"
    assert value_of(spark, variability_severity(F.lit(0.04), F.lit(0.05), F.lit("text"))) == "medium"


@pytest.mark.parametrize(
    "counts, columns, expected",
    [({}, 10, 1.0), ({"critical": 1}, 10, 0.88), ({"high": 1}, 10, 0.95), ({"medium": 1}, 10, 0.99),
     ({"low": 1}, 10, 0.997), ({"critical": 3}, 10, 0.64), ({"critical": 100}, 10, 0.03),
     ({"critical": 1, "high": 1, "medium": 1, "low": 1}, 10, 0.817),
     ({"critical": 3, "high": 5, "medium": 10, "low": 8}, 12, 0.33), ({"Critical": 2, "odd": 4}, 10, 1.0)],
)
def test_quality_score(spark, counts, columns, expected):
    rows = [(s,) for s, n in counts.items() for _ in range(n)]
    found = quality_score(severity_counts(frame(spark, "severity string", rows)), F.lit(columns))
    assert found.first()["quality_score"] == pytest.approx(expected, abs=5e-5)


@pytest.mark.parametrize(
    "value, critical, new, expected",
    [(0.95, 0, 0, "PASSED"), (0.85, 0, 0, "PASSED"), (0.90, 0, 5, "PASSED"), (0.75, 0, 0, "WARNING"),
     (0.95, 0, 10, "WARNING"), (1.0, 1, 0, "FAILED"), (0.50, 0, 0, "FAILED"), (0.75, 1, 20, "FAILED"),
     (0.30, 0, 100, "FAILED")],
)
def test_gate(spark, value, critical, new, expected):
    verdict = gate_status(F.lit(value), F.lit(critical), F.lit(new), 70, 10, 0, 5)
    assert value_of(spark, verdict) == expected


# ---- fingerprints and scalars ---------------------------------------------------------------


def test_fingerprints(spark):
    known = {
        "042800c80d5e181b": column_fingerprint("completeness", "_dataset_", 0.95),
        "20c12ead6745c197": column_fingerprint("completeness", "email"),
        "6b98af09ce48c8b7": duplicate_rows_fingerprint(),
        "ea16b01de0012845": variability_fingerprint("customer_id", 0.95),
        "e7e0c6c17e00a852": expected_unique_fingerprint("id", 1.0),
        "bbb72a8374f9095e": staleness_fingerprint("ts", 30),
        "c32a53ed3d712df5": outlier_fingerprint("price", "iqr", 1.5),
        "29d46df383e7e3b5": balance_fingerprint("target", "dominant_class"),
        "a3e55ba6cbe14169": diversity_fingerprint("country", "missing_value", "DE"),
        "2abce916f4ff1a3a": rule_fingerprint("a > b"),
        "347b85c1867aa7f1": syntactic_fingerprint("email", "email"),
    }
    row = spark.range(1).select(*[c.alias(k) for k, c in known.items()]).first()
    assert list(row) == list(known)


def test_fingerprint_ignores_case_space_and_order(spark):
    a = fingerprint(" Completeness ", F.lit("EMAIL "), params={"b": 1, "a": ["Y", "x"]})
    b = fingerprint("completeness", "email", params={"a": ["x", "y"], "b": 1})
    row = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert row["a"] == row["b"]


@pytest.mark.parametrize(
    "days, expected",
    [(None, "Desconocido"), (0, "Hoy"), (1, "1 dia"), (29, "29 dias"), (30, "1 mes"), (61, "2 meses y 1 dia"),
     (62, "2 meses y 2 dias"), (365, "1 año"), (400, "1 año y 1 mes"), (1195, "3 años y 3 meses")],
)
def test_age_text(spark, days, expected):
    assert value_of(spark, age_text(F.lit(days).cast("bigint"))) == expected


@pytest.mark.parametrize("x", [1.0, 0.1, 1e7, 1e15, 1e16, 1.5e17, 1e-5, 1.2345e-7, -0.00012, 123456.789, -2.5, 1e22])
def test_float_text_reads_like_python(spark, x):
    assert value_of(spark, float_text(F.lit(x))) == repr(x)


def test_integral_text(spark):
    assert value_of(spark, integral_text(F.lit(658892118.0))) == "658892118"
    assert value_of(spark, integral_text(F.lit(1.5))) == "1.5"


def test_dates(spark):
    data = frame(spark, "s string", [("2024-02-30",), ("31/12/2023",), ("12/31/2023",), ("2024-01-02T03:04:05",), ("x",)])
    got = [r[0] for r in data.select(F.date_format(to_timestamp(F.col("s")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == [None, "2023-12-31 00:00", None, "2024-01-02 03:04", None]


def test_semantic_types(spark):
    rows = [("user_id", "string", 3), ("x_key", "integer", 9), ("c", "string", 20), ("t", "string", 21), ("n", "integer", 2)]
    data = frame(spark, "name string, kind string, n int", rows)
    got = [r[0] for r in data.select(semantic_type(F.col("name"), F.col("kind"), F.col("n"))).collect()]
    assert got == ["ID", "ID", "categorical", "text", "numeric"]
