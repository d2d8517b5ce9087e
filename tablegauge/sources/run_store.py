"""Stored runs and issues, written by commits that show whole or not at all.

    store/runs/commit=<id>/project_id=<p>/...      rows of one commit, files per project by size
    store/issues/commit=<id>/project_id=<p>/...
    store/manifest/...                             one row, in one file, per published commit

A write first lays the rows of its commit down in folders of their own, which no reader looks at, and
then publishes the commit by one manifest row. A write that fails half-way leaves folders without a
row; the retry overwrites them under the same id, and a retry of a published commit does nothing. A run
that is written again stands in a later commit: readers take each run, and its issues, from the last
commit that holds it. `compact` writes all live rows as one commit, from which readers then start.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.session import checkpointed, dealt

MANIFEST = "commit string, seq bigint, is_base boolean, runs_schema string, issues_schema string"
TABLES = ("runs", "issues")


class RunStore:
    """The tables `runs` (a row per `run_id`) and `issues` below a shared folder.

    Both need `run_id` and `project_id`. Commits are numbered one after another: one writer at a time.
    Columns may be added by later commits; older rows then hold nulls.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ---- writing

    def write(self, runs: DataFrame, issues: DataFrame, commit: str | None = None) -> str:
        """Store runs with their issues as one commit, and return its id.

        Give the same id on a retry; what a failed attempt left is replaced, and a commit that was
        published before is left as it is.
        """
        commit = commit or f"c-{uuid.uuid4().hex}"
        if not self._is_published(commit):
            self.stage(runs, issues, commit)
            self.publish(commit)
        return commit

    def stage(self, runs: DataFrame, issues: DataFrame, commit: str) -> None:
        """Lay the rows of a commit down without showing them.

        Rows are rebalanced by project: a project gets one file, a large one as many as its size asks
        for, so a hot project is spread over tasks and a small one does not scatter.
        """
        if not commit or not all(c.isalnum() or c in "-_" for c in commit) or not commit[0].isalpha():
            raise ValueError(f"a commit id is a letter, then letters, digits, - and _, not {commit!r}")
        if self._is_published(commit):
            raise ValueError(f"commit {commit} is published and cannot change")
        for name, rows in (("runs", runs), ("issues", issues)):
            missing = {"run_id", "project_id"} - set(rows.columns)
            if missing or "commit" in rows.columns:
                raise ValueError(f"{name} need run_id and project_id, and no column commit")
            rows = rows.withColumns({c: F.col(c).cast("bigint") for c in ("run_id", "project_id")})
            balanced = rows.hint("rebalance", F.col("project_id"))
            balanced.write.mode("overwrite").partitionBy("project_id").parquet(self._place(name, commit))
        self._check(runs.schema, issues.schema, commit)
        self._staged = (commit, runs.schema, issues.schema)

    def publish(self, commit: str, is_base: bool = False) -> None:
        """Show a staged commit: one row in one file, which appears by a rename."""
        staged, runs_schema, issues_schema = getattr(self, "_staged", (None, None, None))
        if staged != commit:
            raise ValueError(f"commit {commit} is not staged")
        last = max((e["seq"] for e in self._entries()), default=0)
        texts = [_stored(schema).json() for schema in (runs_schema, issues_schema)]
        row = self.spark.createDataFrame([(commit, last + 1, is_base, *texts)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def compact(self) -> str:
        """Write all live rows as one commit; what earlier ones hold is no longer read."""
        commit = f"c-{uuid.uuid4().hex}"
        self.stage(self.runs(), self.issues(), commit)
        self.publish(commit, is_base=True)
        return commit

    def _check(self, runs_schema: T.StructType, issues_schema: T.StructType, commit: str) -> None:
        runs, issues = (
            self.spark.read.schema(_stored(schema)).parquet(self._place(name, commit)).select("run_id")
            for name, schema in zip(TABLES, (runs_schema, issues_schema), strict=True)
        )
        count = lambda rows, name: F.lit(int(rows == name)).alias(rows)
        both = runs.select("run_id", *[count(c, "runs") for c in TABLES]).unionAll(issues.select("run_id", *[count(c, "issues") for c in TABLES]))
        per_run = both.groupBy("run_id").agg(F.sum("runs").alias("runs"), F.max("issues").alias("issues"))
        wrong = per_run.where("runs <> 1 OR run_id IS NULL").limit(1).collect()
        if wrong and wrong[0]["runs"]:
            raise ValueError(f"run {wrong[0]['run_id']} stands in the commit twice or has no id")
        if wrong:
            raise ValueError(f"the commit holds issues, but no row, of run {wrong[0]['run_id']}")

    # ---- reading

    def commits(self) -> DataFrame:
        """(commit, seq) of the published commits that readers look at."""
        return self.spark.createDataFrame([(e["commit"], e["seq"]) for e in _live(self._entries())], "commit string, seq bigint")

    def runs(self) -> DataFrame:
        """Each run once, as its last commit holds it."""
        return self._last("runs")

    def issues(self) -> DataFrame:
        """The issues of each run's last commit."""
        return self._last("issues")

    def _last(self, name: str) -> DataFrame:
        """The rows of each run's last commit: those of runs in several commits are told from what was superseded.

        A commit holds a run once, and issues only of its own runs, so the number of the commit decides.
        """
        rows, names = self._rows(name)
        if len(_live(self._entries())) > 1:
            written = dealt(self._rows("runs")[0].select("run_id", "seq"), "run_id")
            span = written.groupBy("run_id").agg(F.min("seq").alias("__first"), F.max("seq").alias("__last"))
            again = checkpointed(span.where("__first < __last").select("run_id", "__last"))
            rows = rows.join(dealt(again, "run_id"), "run_id", "left").where("__last IS NULL OR seq = __last")
        return rows.select(*[F.col(f"`{c}`") for c in names])

    def _rows(self, name: str) -> tuple[DataFrame, list[str]]:
        """All rows of the live commits with their `seq`; only the folders of these commits are listed.

        A commit may hold most rows, so its number is broadcast rather than joined by shuffle.
        """
        live = _live(self._entries())
        if not live:
            raise ValueError(f"no commit is published in {self.folder}")
        schema = T.StructType.fromJson(json.loads(live[-1][f"{name}_schema"]))
        names = [f.name for f in schema.fields]
        files = self.spark.read.schema(schema.add("commit", "string")).option("basePath", f"{self.folder}/{name}")
        rows = files.parquet(*[self._place(name, e["commit"]) for e in live])
        return rows.join(F.broadcast(self.commits()), "commit"), names

    def _is_published(self, commit: str) -> bool:
        return any(e["commit"] == commit for e in self._entries())

    def _entries(self) -> list:
        """The manifest, a short row per commit, in the order of publication."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").orderBy("seq", "commit").collect()
        except AnalysisException:  # nothing was published yet
            return []

    def _place(self, name: str, commit: str) -> str:
        return f"{self.folder}/{name}/commit={commit}"


def _stored(schema: T.StructType) -> T.StructType:
    """The schema as stored: ids are long, and the project stands in the folder names, so it comes last."""
    ids = ("run_id", "project_id")
    fields = [T.StructField(f.name, T.LongType() if f.name in ids else f.dataType) for f in schema.fields]
    return T.StructType([f for f in fields if f.name != "project_id"] + [f for f in fields if f.name == "project_id"])


def _live(entries: list) -> list:
    """The entries from the last base on."""
    first = max((e["seq"] for e in entries if e["is_base"]), default=0)
    return [e for e in entries if e["seq"] >= first]
