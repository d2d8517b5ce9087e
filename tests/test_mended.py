"""Inputs that the driver's tables do not hold: odd dates, files, long texts, hostile or failing rules."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablegauge import EvaluationContext, evaluate
from tablegauge.functions.scalars import to_timestamp
from tablegauge.operators.correlation import pearson
from tablegauge.operators.drilldown import page, search
from tablegauge.operators.duplicates import duplicate_groups
from tablegauge.operators.rules import LogicalConsistency, prepare_rules, split_if_then
from tablegauge.sources.csv_files import read_csv, sniff

MOMENT = dt.datetime(2024, 1, 5, 10, 0)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-01-05T10:00:00Z", MOMENT),
        ("2024-01-05T12:00:00+02:00", MOMENT),
        ("2024-01-05 12:00+0200", MOMENT),
        ("2024-01-05T08:00:00-02", MOMENT),
        ("2024-01-05T10:00", MOMENT),
        ("2024-01-05 10:00:00.5", MOMENT + dt.timedelta(milliseconds=500)),
        ("2024-01-05T10:00:00.123456789Z", MOMENT + dt.timedelta(microseconds=123456)),
        ("2024-01-05T10:00:00.123", MOMENT + dt.timedelta(milliseconds=123)),
        ("05-01-2024", dt.datetime(2024, 1, 5)),
        ("2024-13-05T10:00:00Z", None),
        ("2024-01-05T25:00", None),
        ("2024-01-05T10:00:00.1234567890", None),
        ("2024-01-05T10", None),
    ],
)
def test_iso_times(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(to_timestamp(F.col("t")).alias("t"))
    assert got.selectExpr("date_format(t, 'yyyy-MM-dd HH:mm:ss.SSSSSS')").first()[0] == (
        expected and expected.strftime("%Y-%m-%d %H:%M:%S.%f")
    )


def test_encoding_is_decided_on_all_lines(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"a,b\n" + b"x,y\n" * 5000 + "caf\xe9,\x80\n".encode("latin-1"))
    assert sniff(spark, str(path))["encoding"] == "ISO-8859-1"
    last = read_csv(spark, str(path)).where("a <> 'x'").first()
    assert tuple(last) == ("café", "€")
    path = tmp_path / "plain.csv"
    path.write_text("a,b\ncafé,�\n", encoding="utf-8")
    assert tuple(read_csv(spark, str(path)).first()) == ("café", "�")


def test_long_rows_are_not_cut(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text('a,b\n1,2\n3,4,5\n6\n"x, y",7\n')
    with pytest.raises(ValueError, match="1 rows .* 3,4,5"):
        read_csv(spark, str(path))
    kept = read_csv(spark, str(path), malformed="keep")
    assert sorted((r.a, r.b, r._malformed) for r in kept.collect()) == [
        ("1", 2, None), ("3", 4, "3,4,5"), ("6", None, None), ("x, y", 7, None),
    ]


@pytest.mark.parametrize("length", [3, 64, 65, 5000])
def test_duplicates_are_listed_by_value_whatever_their_length(spark, length):
    texts = ["aaa", "z" * length, "tttt", "z" * length, "aaa", "tttt", "one"]
    got = duplicate_groups(spark.createDataFrame([(t, i % 1) for i, t in enumerate(texts)], "t string, i int"))
    assert [(r.key__0, r.cnt) for r in got.orderBy("group_id").collect()] == [("aaa", 2), ("tttt", 2), ("z" * length, 2)]


def test_search_pattern_is_left_as_it_is(spark):
    df = spark.createDataFrame([("123",), ("Abc",)], "t string")
    assert [r.t for r in search(df, r"^\D+$", regex=True).collect()] == ["Abc"]
    assert [r.t for r in search(df, "aB").collect()] == ["Abc"]


def test_pages_go_backwards(spark):
    rows = [(i, i % 3 if i % 4 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, g int")
    order = ["-g", "i"]
    whole = [tuple(r) for r in page(df, order, 1, 20).collect()]
    assert whole == sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -1), r[0]))
    seen, after = [], None
    while part := [tuple(r) for r in page(df, order, 1, 6, after=after).collect()]:
        seen += part
        after = [part[-1][1], part[-1][0]]
    assert seen == whole


RULES = [
    ("id IN (TABLE secrets)", "blocked"),
    ("id IN (FROM secrets)", "blocked"),
    (r"s = r'\' OR reflect('java.lang.Math','abs',id) > '5'", "blocked"),
    ("exists(SELECT 1)", "blocked"),
    ("rand() > 0.5", "blocked"),
    ("sum(id) > 5", "blocked"),
    ("row_number() over (order by id) > 5", "blocked"),
    ("10 / x > 5", "error"),
    ("cast(s as int) > 5", "error"),
    ("missing > 5", "error"),
    ("x > 1", None),
]


def rule_table(spark):
    spark.createDataFrame([(1,)], "id int").createOrReplaceTempView("secrets")
    return spark.createDataFrame([(1, 0, "a"), (2, 2, "7"), (3, 5, "b")], "id int, x int, s string")


def test_rules_stay_in_their_row_and_fail_alone(spark):
    df = rule_table(spark)
    rules = [{"name": e, "type": "violation", "expression": e} for e, _ in RULES]
    got = {r.expression: r for r in LogicalConsistency().run(df, {"rules": rules}).columns.collect()}
    for expression, outcome in RULES:
        row = got[expression]
        assert (row.blocked, row.error is not None) == (outcome == "blocked", outcome == "error"), expression
    assert (got["x > 1"].n_violations, got["x > 1"].n_scope) == (2, 3)


def test_a_failing_rule_does_not_end_the_run(spark):
    rules = [{"name": e, "type": "violation", "expression": e} for e in ("10 / x > 5", "x > 1")]
    config = {"metrics": [
        {"id": "completeness", "parameters": {"columns": ["id", "s"]}},
        {"id": "logical_consistency", "parameters": {"rules": rules}},
    ]}
    result = evaluate(rule_table(spark), config, EvaluationContext())
    assert {r.metric: r.score for r in result.scores.collect()} == {"completeness": 1.0, "logical_consistency": pytest.approx(1 / 3)}
    assert not result.skipped


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("IF a = 'then' THEN b", ("a = 'then'", "b")),
        ("when CASE WHEN x THEN y ELSE z END\nthen b > 1", ("CASE WHEN x THEN y ELSE z END", "b > 1")),
        ("si `then` = 1 entonces c", ("`then` = 1", "c")),
        ("IF a\n  AND b\nTHEN c", ("a\n  AND b", "c")),
        ("a THEN b", None),
        ("IF a", None),
        ("IF THEN b", None),
    ],
)
def test_if_then_scanner(text, parts):
    assert split_if_then(text) == parts


def test_pearson_of_a_wide_table(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(50, 30)), columns=[f"c{i}" for i in range(30)])
    got = {(r[0], r[1]): r[2] for r in pearson(spark.createDataFrame(pdf)).collect()}
    expected = pdf.corr()
    assert len(got) == 435
    assert all(v == pytest.approx(expected.loc[a, b], abs=1e-9) for (a, b), v in got.items())


def test_two_part_rules(spark):
    rule = prepare_rules(rule_table(spark), [{"type": "if_then", "expression": "IF s = 'then' THEN x > 1"}])[0]
    assert rule.violates is not None and rule.columns == ["x", "s"]
