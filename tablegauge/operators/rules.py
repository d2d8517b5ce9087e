"""Logical consistency: rules over the columns of a row, written as Spark SQL conditions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.fingerprints import rule_fingerprint
from tablegauge.functions.scalars import percent_text
from tablegauge.functions.severity import severity
from tablegauge.operators.column_stats import row_count
from tablegauge.operators.findings import (
    SAMPLE_ROWS,
    Metric,
    MetricFrames,
    details,
    first_rows_per_group,
    fixed_score,
    issues_of,
    no_issues,
    order_columns,
    ordered_sample,
    row_sample,
)
from tablegauge.session import local_rows

# Words a rule may not contain.
FORBIDDEN_WORDS = (
    "import", "__", "exec", "eval", "compile",
    "globals", "locals", "getattr", "setattr", "delattr",
    "open", "os.", "sys.", "subprocess", "shutil",
    "lambda", "def ", "class ",
)
# Parts of a resolved condition that leave the row it is checked on: other tables, Java methods, and
# functions registered by someone. Aggregates, windows and generators show as plan steps of their own.
ROW_PLAN_STEPS = {"Project", "LocalRelation", "LogicalRDD"}
REFUSED_PARTS = {
    "ScalarSubquery", "InSubquery", "ListQuery", "Exists", "LateralSubquery",
    "CallMethodViaReflection", "TryReflect",
}

QUOTED_TEXT = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
# The words that open the two parts of a conditional rule.
IF_WORDS, THEN_WORDS = ("if", "si", "when", "cuando"), ("then", "entonces")
RULE_TOKEN = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|\w+|\s+|."

RULE_SCHEMA = (
    "rule_index int, name string, type string, expression string, blocked boolean, error string, "
    "n_rows bigint, n_scope bigint, n_violations bigint, compliance double, affected_columns string"
)


@dataclass
class Rule:
    """A rule made ready for one table: its scope and violation conditions, or why it has none."""

    index: int
    name: str
    type: str
    expression: str
    scope: Column | None = None
    violates: Column | None = None
    blocked: bool = False
    error: str | None = None
    columns: list[str] = field(default_factory=list)


def forbidden_word(text: str) -> str | None:
    """The first forbidden word in a rule, as a whole word; quoted texts are data, not code."""
    code = re.sub(QUOTED_TEXT, "''", text.lower())
    for word in FORBIDDEN_WORDS:
        core = word.strip()
        start = r"(?<![a-z0-9_])" if core[0].isalpha() else ""
        end = r"(?![a-z0-9_])" if core[-1].isalpha() else ""
        if re.search(start + re.escape(core) + end, code):
            return core
    return None


def prepare_rules(df: DataFrame, rules: list[dict]) -> list[Rule]:
    """Check, parse and resolve the rules; a rule that fails is kept with its reason."""
    empty = df.sparkSession.createDataFrame([], df.schema)
    prepared = []
    for index, spec in enumerate(rules):
        kind = spec.get("type", "violation")
        expression = spec.get("expression") or ""
        condition, assertion = spec.get("condition") or "", spec.get("assertion") or ""
        if not expression and not (kind == "if_then" and condition and assertion):
            continue
        # A rule written in two parts is identified by both of them.
        identity = expression or f"{condition} => {assertion}"
        rule = Rule(index, spec.get("name") or f"Rule {index + 1}", kind, identity)
        prepared.append(rule)
        if any(forbidden_word(text) for text in (expression, condition, assertion)):
            rule.blocked = True
            continue
        if kind == "if_then" and not (condition and assertion):
            parts = split_if_then(expression)
            if not parts:
                rule.error = "not an IF ... THEN ... rule"
                continue
            condition, assertion = parts
        try:
            if any(leaves_row(empty, text) for text in (condition, assertion) if kind == "if_then") or (
                kind != "if_then" and leaves_row(empty, expression)
            ):
                rule.blocked = True
                continue
            if kind == "if_then":
                rule.scope = _holds(condition)
                rule.violates = rule.scope & ~_holds(assertion)
            else:
                rule.scope = F.lit(True)
                rule.violates = _holds(expression)
            empty.select(rule.scope, rule.violates)
            names = _names_used(" ".join((expression, condition, assertion)))
            rule.columns = [c for c in df.columns if c.lower() in names]
        except PySparkException as error:
            rule.error = error.getCondition() or "invalid expression"
            rule.scope = rule.violates = None
    return prepared


def split_if_then(text: str) -> tuple[str, str] | None:
    """Condition and assertion of an IF ... THEN ... text; a THEN in quotes or in a CASE is not the one."""
    tokens = re.findall(RULE_TOKEN, text.strip(), re.DOTALL)
    if not tokens or tokens[0].lower() not in IF_WORDS:
        return None
    depth = 0
    for i, token in enumerate(tokens[1:], 1):
        word = token.lower()
        if word == "case":
            depth += 1
        elif word == "end" and depth:
            depth -= 1
        elif word in THEN_WORDS and not depth:
            condition, assertion = "".join(tokens[1:i]).strip(), "".join(tokens[i + 1 :]).strip()
            return (condition, assertion) if condition and assertion else None
    return None


def leaves_row(empty: DataFrame, condition: str) -> bool:
    """Whether a condition needs more than the cells of its row and built-in, repeatable functions.

    The condition is resolved on an empty frame and its tree is judged, whatever way it was written.
    """
    steps = [empty.select(F.expr(condition))._jdf.queryExecution().analyzed()]
    parts = []
    while steps:
        step = steps.pop()
        if step.nodeName() not in ROW_PLAN_STEPS:
            return True
        steps += _members(step.children())
        parts += _members(step.expressions())
    while parts:
        part = parts.pop()
        name = part.getClass().getSimpleName()
        if name in REFUSED_PARTS or "UDF" in name or not part.deterministic():
            return True
        parts += _members(part.children())
    return False


def _members(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def without_failing(df: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules, those that fail on some row listed with their error; each is tried by itself."""
    for rule in rules:
        if rule.violates is None:
            continue
        try:
            df.agg(F.count_if(rule.scope), F.count_if(rule.violates)).collect()
        except PySparkException as error:
            rule.error = error.getCondition() or "fails on a row"
            rule.scope = rule.violates = None
    return rules


def _counts(rules: list[Rule]) -> list[Column]:
    out = []
    for rule in rules:
        if rule.violates is not None:
            out.append(F.count_if(rule.scope).alias(f"rule_scope__{rule.index}"))
            out.append(F.count_if(rule.violates).alias(f"rule_bad__{rule.index}"))
    return out


def _holds(condition: str) -> Column:
    """A condition that counts as false when it is null."""
    return F.coalesce(F.expr(condition).cast("boolean"), F.lit(False))


def _names_used(code: str) -> set[str]:
    """Lower-cased column names in a condition: words outside quoted texts that call nothing."""
    code = re.sub(QUOTED_TEXT, " ", code.lower())
    quoted = set(re.findall(r"`([^`]+)`", code))
    return quoted | set(re.findall(r"(?<![\w`])[a-z_]\w*(?!\w|\s*\()", code))


class LogicalConsistency(Metric):
    """params: rules [{name, type: violation|if_then, expression, condition, assertion}]."""

    metric_id = "logical_consistency"

    def aggregates(self, df, params, context):
        return _counts(prepare_rules(df, params.get("rules") or []))

    def frames(self, df, shared, params, context) -> MetricFrames:
        spark = df.sparkSession
        rules = prepare_rules(df, params.get("rules") or [])
        if not rules:
            return MetricFrames(
                fixed_score(spark, self.metric_id, None),
                spark.createDataFrame([], RULE_SCHEMA),
                no_issues(spark),
            )
        # One row per rule.
        try:
            results = local_rows(shared.wide.select(F.inline(F.array(*[_rule_row(rule) for rule in rules]))))
        except PySparkException:
            rules = without_failing(df, rules)
            wide = df.agg(row_count(), *_counts(rules))
            results = local_rows(wide.select(F.inline(F.array(*[_rule_row(rule) for rule in rules]))))
        score = results.agg(F.coalesce(F.avg("compliance"), F.lit(1.0)).alias("score")).select(
            F.lit(self.metric_id).alias("metric"), "score"
        )
        violated = results.where("n_violations > 0")
        broken = {row["rule_index"] for row in violated.collect()}
        samples = violation_samples(df, [rule for rule in rules if rule.index in broken], context)
        violated = violated.join(F.broadcast(samples), "rule_index", "left")
        share = percent_text(F.col("compliance"))
        issues = issues_of(
            violated,
            self.metric_id,
            issue_type="logical_consistency",
            severity=severity("ratio", F.col("compliance"), 1.0),
            column_name=F.col("affected_columns"),
            rule_key="cross_field_check",
            description=F.concat(
                F.lit("Rule "), "name", F.lit(" broken by "),
                F.col("n_violations").cast("string"), F.lit(" rows"),
            ),
            actual_value=share,
            affected_row_count=F.col("n_violations"),
            details=details(name=F.col("name"), expression=F.col("expression")),
            sample=F.col("sample"),
            fingerprint=rule_fingerprint(F.col("expression")),
        )
        blocked = issues_of(
            results.where("blocked"),
            self.metric_id,
            issue_type="logical_consistency",
            severity="high",
            rule_key="cross_field_check",
            description=F.concat(F.lit("Rule "), "name", F.lit(" was blocked: it has a forbidden word or leaves its row")),
            details=details(name=F.col("name"), expression=F.col("expression")),
            fingerprint=rule_fingerprint(F.col("expression")),
        )
        return MetricFrames(score, results, issues.unionByName(blocked))


def _rule_row(rule: Rule) -> Column:
    if rule.violates is None:
        scope = bad = compliance = F.lit(None)
    else:
        scope, bad = F.col(f"rule_scope__{rule.index}"), F.col(f"rule_bad__{rule.index}")
        compliance = F.coalesce(1 - F.try_divide(bad, scope), F.lit(1.0))
    return F.struct(
        F.lit(rule.index).alias("rule_index"),
        F.lit(rule.name).alias("name"),
        F.lit(rule.type).alias("type"),
        F.lit(rule.expression).alias("expression"),
        F.lit(rule.blocked).alias("blocked"),
        F.lit(rule.error).cast("string").alias("error"),
        F.col("n_rows").alias("n_rows"),
        scope.cast("bigint").alias("n_scope"),
        bad.cast("bigint").alias("n_violations"),
        compliance.cast("double").alias("compliance"),
        F.lit(",".join(rule.columns)).alias("affected_columns"),
    )


def violation_samples(df: DataFrame, rules: list[Rule], context) -> DataFrame:
    """(rule_index, sample): up to five violating rows per rule, all rules in one scan."""
    hits = [F.when(r.violates, F.lit(r.index)) for r in rules if r.violates is not None]
    if not hits:
        return df.sparkSession.createDataFrame([], "rule_index int, sample array<string>")
    exploded = df.select(
        F.struct(*order_columns(df, context.id_columns)).alias("place"),
        row_sample(df, context.sensitive).alias("row"),
        F.explode(F.array_compact(F.array(*hits))).alias("rule_index"),
    )
    first = first_rows_per_group(exploded, "rule_index", [F.col("place")], SAMPLE_ROWS)
    return first.groupBy("rule_index").agg(ordered_sample("sample_rank", "row").alias("sample"))
