"""Data-quality auditing of tables as Spark DataFrame jobs."""

from tablegauge.plans.compare import compare_runs, compare_versions
from tablegauge.plans.evaluate import EvaluationContext, evaluate, register_metric
from tablegauge.plans.profile import profile

__all__ = [
    "EvaluationContext",
    "evaluate",
    "register_metric",
    "profile",
    "compare_runs",
    "compare_versions",
]
