"""Exact top-k inner products by aggregation over sorted lists, without random access.

A block of candidates holds one list per component: the candidates' values in order, each with the number
of its candidate. For a query the lists are read in slices, each from the end that gives the largest
products, all to the same depth. An entry adds its product to the sum of the candidate it names; what a
candidate has not been met in lies between the value where reading stands and the list's other end. That
gives a lower and an upper bound of every candidate met, and one upper bound of all others. Reading stops
when the k-th best lower bound is above the upper bounds of all outsiders; then the final scores of
the k found are resolved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablegauge.llm.common import checkpointed

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 512
#: Shares of the lists up to which they are read before bounds are compared.
DEPTHS = (1 / 32, 1 / 4, 1)
#: Scores travel as decimals of 38 digits and are returned as longs.
LARGEST_SCORE = 10**38 - 1
LARGEST_LONG = (1 << 63) - 1


def integer_vectors(table: DataFrame, id_column: str, vector: str, scale: int = 256) -> DataFrame:
    """`row`, `id` and `v` = floor(scale * component), whole numbers as doubles, which hold them exactly.

    Rows with a null id, or a null, a null component or one that is not finite (also after scaling by a
    power of two) take no part. `row` tells equal rows apart; the table is written once.
    """
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    valid = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = table.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & valid)
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    numbered = kept.select(F.col(id_column).cast("long").alias("id"), F.transform(scaled, whole).alias("v"))
    return checkpointed(numbered.select(F.monotonically_increasing_id().alias("row"), "id", "v"))


@dataclass
class Block:
    """Candidates in ascending order of id and row, their components (shorter vectors end in zeros), and per
    component its list: values in ascending order, and the candidates they belong to."""

    rows: np.ndarray
    ids: np.ndarray
    matrix: np.ndarray
    values: np.ndarray
    names: np.ndarray

    @cached_property
    def largest(self) -> float:
        return float(np.abs(self.matrix).max(initial=0))

    @classmethod
    def of(cls, rows: bytes, ids: bytes, matrix: bytes, lists: bool = True) -> Block:
        rows = np.frombuffer(rows, "<i8")
        matrix = np.frombuffer(matrix, "<f8").reshape(len(rows), -1 if matrix else 0)
        names = np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").T) if lists else np.zeros((0, 0), dtype=np.int64)
        values = np.take_along_axis(matrix.T, names, axis=1) if lists else names
        return cls(rows, np.frombuffer(ids, "<i8"), matrix, values, names)

    def read(self, used: np.ndarray, from_end: bool, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates and values of a slice of the lists of some components, read from their end or start."""
        n = len(self.rows)
        part = slice(n - end, n - first) if from_end else slice(first, end)
        return self.names[used, part], self.values[used, part]


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
    vectors = rows.column("v").to_pylist()
    matrix = np.zeros((len(vectors), max(map(len, vectors))), dtype="<f8")
    for i, v in enumerate(vectors):
        matrix[i, : len(v)] = v
    data = {
        "block": [key[0].as_py()],
        "rows": [rows.column("row").to_numpy().astype("<i8").tobytes()],
        "ids": [rows.column("id").to_numpy().astype("<i8").tobytes()],
        "matrix": [matrix.tobytes()],
    }
    return pa.table(data, schema=pa.schema([("block", pa.int32()), *[(c, pa.binary()) for c in ("rows", "ids", "matrix")]]))


def _blocks(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    count = max(1, -(-vectors.count() // size))
    by = F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias("block")
    made = vectors.select("row", "id", "v", by).groupBy("block").applyInArrow(_block, "block int, rows binary, ids binary, matrix binary")
    return checkpointed(made), count


def _fits_float(block: Block, query: np.ndarray) -> bool:
    """Whether all sums of products are whole numbers that doubles hold; else Python integers are used."""
    return block.largest * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 1 << 52


def _integers(x: np.ndarray) -> np.ndarray:
    """Whole numbers in doubles as Python integers."""
    return np.array([int(y) for y in x.ravel()], dtype=object).reshape(x.shape)


def _sums(names: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each candidate named."""
    values = np.broadcast_to(values, names.shape)
    if values.dtype != object:
        return np.bincount(names.ravel(), values.ravel(), n)
    out = _integers(np.zeros(n))
    np.add.at(out, names, values)
    return out


def _best(scores: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k candidates of `found` with the largest scores, and all others; of equal scores the first come first."""
    own = scores[found]
    kth = np.partition(own, -k)[-k] if own.dtype != object else sorted(own)[-k]
    chosen = own > kth
    chosen[np.flatnonzero(own == kth)[: k - int(chosen.sum())]] = True
    return found[chosen], found[~chosen]


def query_top(query_row: int, query: np.ndarray, block: Block, k: int) -> list[tuple[int, int]]:
    """Candidate number and exact score of the k best candidates of a block for a query, in no order.

    Equal scores go to the candidate that comes first. The query's own row is no candidate.
    """
    n, width = block.matrix.shape
    weights = np.zeros(width, dtype=np.float64)
    weights[: min(width, len(query))] = query[:width]
    others = block.rows != query_row
    wanted = min(k, int(others.sum()))
    whole = _fits_float(block, weights)
    exact = (lambda x: x) if whole else _integers
    # lists of positive weights are read from their end, those of negative ones from their start
    sides = [(used, exact(weights[used])[:, None], end) for used, end in ((np.flatnonzero(weights > 0), True), (np.flatnonzero(weights < 0), False)) if len(used)]
    if not wanted or not sides:  # all scores are 0
        return [(int(c), 0) for c in np.flatnonzero(others)[:wanted]]
    # the least that each list can add, and per candidate how much its entries are above that
    floors = [w * exact(block.read(used, end, n - 1, n)[1]) for used, w, end in sides]
    lowest = sum(floor.sum() for floor in floors)
    above, done = 0, 0
    for share in DEPTHS:
        depth = n if share == 1 else int(np.ceil(n * share))
        for (used, w, end), floor in zip(sides, floors, strict=True):
            names, values = block.read(used, end, done, depth)
            above = above + _sums(names, exact(values) * w - floor, n)
        done = depth
        low = above + lowest
        # what adds no more than a list's least is as good as not met
        found = np.flatnonzero(others & (above > 0)) if done < n else np.flatnonzero(others)
        if len(found) < wanted:
            continue
        best, rest = _best(low, found, wanted)
        if done == n:
            break
        kth = low[best].min()
        limits = [w * exact(block.read(used, end, done - 1, done)[1]) - floor for (used, w, end), floor in zip(sides, floors, strict=True)]
        unseen = sum(limit.sum() for limit in limits)
        if kth <= unseen + lowest and len(found) < others.sum():
            continue
        # the lists that a candidate was met in add no more, all others up to where reading stands
        room = sum(_sums(block.read(used, end, 0, done)[0], limit, n) for (used, _, end), limit in zip(sides, limits, strict=True))
        if not len(rest) or kth > (low + unseen - room)[rest].max():
            break
    full = exact(weights)
    return [(int(c), int(full @ exact(block.matrix[c]))) for c in best]


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score` of each query row's k best candidate rows, ties to the smaller id.

    Both tables come from one `integer_vectors`. Every row of `vectors` is a candidate but the query's
    own, equal rows and rows of one id each by themselves; so are query rows. Every block of queries meets
    every block of candidates once, a pair to a task; a pair gives k rows a query. Vectors of different
    lengths are compared as if the shorter ended in zeros. Sums are exact whatever their size; a score
    that no long holds is returned as the nearest long, with its rank by the exact score (scores of 38
    digits and more count as equal). Empty tables give an empty result.
    """
    candidates, n_candidates = _blocks(vectors, CANDIDATE_BLOCK)
    asked, n_queries = _blocks(queries, QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = ["rows", "ids", "matrix"]
    left = candidates.select(F.col("block").alias("c"), every(n_queries).alias("q"), *parts)
    right = asked.select(F.col("block").alias("q"), every(n_candidates).alias("c"), *[F.col(x).alias(f"query_{x}") for x in parts])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, matrix, query_rows, query_ids, query_matrix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block.of(rows, ids, matrix)
                asked = Block.of(query_rows, query_ids, query_matrix, lists=False)
                out: tuple[list, ...] = ([], [], [], [])
                for number, query in enumerate(asked.matrix):
                    for place, score in query_top(int(asked.rows[number]), query, block, k):
                        found = (asked.ids[number], asked.rows[number], block.ids[place], Decimal(max(-LARGEST_SCORE, min(LARGEST_SCORE, score))))
                        for column, value in zip(out, found, strict=True):
                            column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["query_id", "query_row", "vec_id", "score"])

    pairs = left.join(right, ["c", "q"]).select(*parts, *[f"query_{x}" for x in parts])
    found = pairs.mapInArrow(search, "query_id long, query_row long, vec_id long, score decimal(38, 0)")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    held = F.least(F.greatest(F.col("score"), F.lit(Decimal(-LARGEST_LONG - 1))), F.lit(Decimal(LARGEST_LONG))).cast("long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", held.alias("score"))


def top_inner_products_sql(k: int, every: int) -> str:
    return f"""
WITH numbered AS (SELECT vec_id, embedding, row_number() OVER () AS place FROM embeddings WHERE vec_id IS NOT NULL),
parts AS (
    SELECT vec_id, place, unnest(range(len(embedding))) AS i, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x
    FROM numbered
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT q.vec_id AS query_id, q.place AS query_place, c.vec_id, c.place, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM parts q JOIN parts c ON q.i = c.i AND q.place <> c.place
    WHERE q.vec_id % {every} = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_place ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scores QUALIFY rank <= {k}
"""
