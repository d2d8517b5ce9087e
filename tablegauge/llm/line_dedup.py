"""Boilerplate lines by the number of distinct sites that hold them.

A HyperLogLog sketch of the sites per line hash is merged by aggregation, so the state of a line has a
fixed size however often it occurs. Lines whose estimate is well below the threshold stay; lines near
it get an exact distinct count; a line that reaches the threshold is boilerplate. Its first occurrence
(smallest document id, then place) stays where it is, the others are removed, so no text is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import checkpointed, row_key

MIN_SITES = 5
#: log2 of the registers of a sketch; small sets are kept as lists, so a rare line takes few bytes.
SKETCH_LOG2 = 9
#: Estimates from this share of the threshold up to its inverse are near it. At 512 registers the
#: standard error is under 5 %, so the band is more than ten of them wide on either side.
NEAR = 0.5
#: Up to so many lines (16 bytes each, and a place) are broadcast to the tasks that hold their occurrences;
#: more are joined by shuffle, with the occurrences of a line dealt to `SALTS` tasks.
BROADCAST_LINES = 500_000
SALTS = 16


def line_sites(lines: DataFrame) -> DataFrame:
    """`line_a`, `line_b` (hash), `sites` (estimate) and `first` occurrence per distinct line."""
    sketch = F.hll_sketch_agg(F.xxhash64("site"), F.lit(SKETCH_LOG2))
    return lines.groupBy("line_a", "line_b").agg(
        F.hll_sketch_estimate(sketch).alias("sites"), F.min(F.struct("id", "key", "place")).alias("first")
    )


def _meet(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """The occurrences of the chosen lines, which are distinct, with their columns; a frequent line is no task's alone."""
    keys = ["line_a", "line_b"]
    if chosen.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(chosen), keys)
    salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("key", "place"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """`line_a`, `line_b` and `first` of the lines on `min_sites` sites or more; no approximation is left."""
    spread = checkpointed(line_sites(lines).where(F.col("sites") >= NEAR * min_sites))
    near = spread.where(F.col("sites") < min_sites / NEAR).select("line_a", "line_b")
    exact = (
        _meet(lines, near)
        .select("line_a", "line_b", F.xxhash64("site").alias("site"))
        .distinct()
        .groupBy("line_a", "line_b")
        .agg(F.count(F.lit(1)).alias("exact"))
    )
    counted = spread.join(exact, ["line_a", "line_b"], "left")
    return counted.where(F.coalesce("exact", "sites") >= min_sites).select("line_a", "line_b", "first")


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, count: str = "lines_removed") -> DataFrame:
    """`docs` with all its columns and rows, `text` without repeated boilerplate lines, plus their number as `count`.

    Lines are split at line feeds and compared as they are; blank lines are never boilerplate. A null
    site is one site. A null text stays null, a text of which every line goes becomes empty. Rows equal
    in id and text are one document: what is removed from one is removed from the other. A column
    of the input called as `count` says is replaced.
    """
    keyed = docs.withColumn("__key", row_key("doc_id", "text"))
    lines = (
        keyed.select(F.col("doc_id").cast("long").alias("id"), "__key", F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
        .where(F.col("line").rlike(r"\S"))
        .select(
            "id", F.col("__key").alias("key"), "place", "site",
            F.xxhash64("line").alias("line_a"), F.xxhash64(F.lit(1), "line").alias("line_b"),
        )
    )
    bad = checkpointed(boilerplate(lines, min_sites))
    hits = (
        _meet(lines, bad)
        .where(F.struct("id", "key", "place") != F.col("first"))
        .groupBy("key")
        .agg(F.collect_set("place").alias("__gone"))
    )

    def without_gone(all_lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__gone"))
        return F.array_join(F.transform(places, lambda i: F.get(all_lines, i)), "\n")

    # only texts that lose a line are split, once, as a lambda of one element holds their lines, which are
    # found by place: linear in the lines of a text
    kept = F.transform(F.array(F.split("text", "\n")), without_gone)
    cleaned = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.get(kept, F.lit(0)))
    names = [c for c in docs.columns if c != count]
    # hits are a few bytes a removed line, and no two share a key: they are hashed, and whole texts need no sort
    return (
        keyed.join(hits.withColumnRenamed("key", "__key").hint("shuffle_hash"), "__key", "left")
        .withColumn("text", cleaned)
        .select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(count))
    )


def line_dedup_sql(min_sites: int = MIN_SITES) -> str:
    return f"""
WITH lines AS (
    SELECT doc_id, source, unnest(range(len(parts))) AS place, unnest(parts) AS line
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
bad AS (
    SELECT line, min(struct_pack(id := doc_id, place := place)) AS first FROM lines
    WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')
    GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= {min_sites}),
kept AS (
    SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) FILTER (b.line IS NULL OR (b.first.id = l.doc_id AND b.first.place = l.place)) AS text,
           count(*) FILTER (b.line IS NOT NULL AND NOT (b.first.id = l.doc_id AND b.first.place = l.place)) AS lines_removed
    FROM lines l LEFT JOIN bad b ON l.line = b.line GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, d.lang, d.source, d.n_chars,
       CAST(coalesce(k.lines_removed, 0) AS BIGINT) AS lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
