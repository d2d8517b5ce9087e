"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text features.

One weight vector w is shared by all grades; ordered thresholds t1 < t2 < ... cut its score:
P(grade < j) = sigmoid(tj - w x). The expected grade and the chance of reaching a grade follow from it.
Features are words (present or not), forms of words (case and trailing marks, by share), and a few
shares of the whole text.
"""

from __future__ import annotations

import tempfile
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.common import free_worker_table, slices, worker_table

WORD_FEATURES = 1 << 18
FORM_FEATURES = 1 << 10
#: Shares of: distinct words, words in capitals, words with odd marks, words without letters; and a constant.
TEXT_FEATURES = 5
FEATURES = WORD_FEATURES + FORM_FEATURES + TEXT_FEATURES
#: Labelled rows that the fit uses at most: those with the smallest hash of their id. Fitting is one
#: task over the features of these rows; scoring covers all rows.
TRAINING_ROWS = 10_000
#: Features that the fit has in memory at a time, but for the last row of a block; the others wait in a file.
BLOCK_FEATURES = 1 << 20
STEPS, RATE, PENALTY = 150, 0.05, 1e-3
#: Rows of either kind that a word is taken to have been seen in beforehand, when its evidence is weighed.
PRIOR_ROWS = 10
SHARE_SCALE = 6.0
ROWS_AT_ONCE = 256
KNOWN_WORDS = 200_000

_MARKS = ".,!?;:|*%#&$@~^_-=+()[]{}<>/\\\"'`"


class _WordFeatures(dict):
    """Word, form and kind of each word seen; kind bits: 1 capitals, 2 odd marks, 4 no letters."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        stem = word.strip(_MARKS)
        marks = word[len(word.rstrip(_MARKS)) :]
        case = "U" if len(stem) > 1 and stem.isupper() else "T" if stem.istitle() else "l" if stem.islower() else "o"
        kind = (case == "U") + 2 * (marks.strip(".,") != "") + 4 * (not any(c.isalpha() for c in stem))
        value = self[word] = (
            zlib.crc32(stem.lower().encode()) % WORD_FEATURES,
            WORD_FEATURES + zlib.crc32((case + marks[-3:]).encode()) % FORM_FEATURES,
            kind,
        )
        return value


def _word_features() -> _WordFeatures:
    return worker_table(("word features",), _WordFeatures)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; a null or empty text has the constant alone."""
    known = _word_features()
    if len(known) > KNOWN_WORDS:
        known.clear()
    counts = Counter((text or "").split())
    total = sum(counts.values()) or 1
    words: dict[int, float] = {}
    forms: Counter[int] = Counter()
    kinds = [0] * 8
    for word, n in counts.items():
        index, form, kind = known[word]
        words[index] = 1.0
        forms[form] += n
        kinds[kind] += n
    shares = [len(counts)] + [sum(n for k, n in enumerate(kinds) if k & bit) for bit in (1, 2, 4)]
    place = WORD_FEATURES + FORM_FEATURES
    index = [*words, *forms, *range(place, place + TEXT_FEATURES)]
    scale = SHARE_SCALE / total
    value = [*words.values(), *(n * scale for n in forms.values()), *(n * scale for n in shares), 1.0]
    return np.array(index, dtype=np.int32), np.array(value, dtype=np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        index, value = features(text)
        return float(self.weights[index] @ value)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """Chance of reaching grade 1, 2, ..., a column each."""
        return 1.0 - _sigmoid(self.thresholds[None, :] - scores[:, None])


class _Sample:
    """The rows of the fit: grades in memory, features in a file without a name, read back in blocks of whole rows."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.grades: list[int] = []
        self.sizes: list[int] = []
        #: First row and row after the last of each block.
        self.blocks: list[tuple[int, int]] = []
        self._open: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = 0

    def add(self, index: np.ndarray, value: np.ndarray, grade: int) -> None:
        self._open.append((index, value))
        self.grades.append(grade)
        self.sizes.append(len(index))
        self._held += len(index)
        if self._held >= BLOCK_FEATURES:
            self.close_block()

    def close_block(self) -> None:
        if self._open:
            for part in (0, 1):
                self.file.write(np.concatenate([row[part] for row in self._open]).tobytes())
            self.blocks.append((len(self.grades) - len(self._open), len(self.grades)))
            self._open, self._held = [], 0

    def read(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each block: its rows, the features of each row, and all their indices and values."""
        self.file.seek(0)
        for low, high in self.blocks:
            sizes = np.array(self.sizes[low:high])
            n = int(sizes.sum())
            index = np.frombuffer(self.file.read(4 * n), dtype=np.int32)
            yield slice(low, high), sizes, index, np.frombuffer(self.file.read(4 * n), dtype=np.float32)


def _evidence(sample: _Sample, top: np.ndarray) -> np.ndarray:
    """How far each word sets the highest grade apart: its log ratio of shares in top and other rows.

    Words scaled by it are found by a few of their rows, and words without bearing stay out of the way.
    """
    in_top, in_rest = np.zeros(FEATURES), np.zeros(FEATURES)
    for rows, sizes, index, _ in sample.read():
        here = np.repeat(top[rows], sizes)
        in_top += np.bincount(index[here], minlength=FEATURES)
        in_rest += np.bincount(index[~here], minlength=FEATURES)
    n_top, n_rest = int(top.sum()), int((~top).sum())
    prior = PRIOR_ROWS * np.array([n_top, n_rest]) / max(1, len(top)) + 1e-9
    ratio = np.log((in_top + prior[0]) / (n_top + prior[0])) - np.log((in_rest + prior[1]) / (n_rest + prior[1]))
    scale = np.abs(ratio)
    scale[WORD_FEATURES:] = 1.0
    return scale


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray]], grades: Iterable[int], n_grades: int) -> OrdinalModel:
    """Full-batch Adam, on evidence-scaled words, of the mean negative log likelihood with a squared penalty on the weights."""
    sample = _Sample()
    with sample.file:
        for (index, value), grade in zip(rows, grades, strict=True):
            sample.add(index, value, int(grade))
        sample.close_block()
        return _descend(sample, n_grades)


def _descend(sample: _Sample, n_grades: int) -> OrdinalModel:
    """Each step sums the gradient over the blocks, so that a block is all it has in memory."""
    all_grades = np.array(sample.grades, dtype=np.int64)
    n = len(all_grades)
    scale = _evidence(sample, all_grades == n_grades - 1)
    weights = np.zeros(FEATURES)
    thresholds = np.linspace(-1.0, 1.0, n_grades - 1) if n_grades > 2 else np.zeros(1)
    first, second = np.zeros(FEATURES + n_grades - 1), np.zeros(FEATURES + n_grades - 1)
    for step in range(1, STEPS + 1):
        scaled = weights * scale
        by_weight, by_threshold = np.zeros(FEATURES), np.zeros(n_grades - 1)
        for rows, sizes, index, value in sample.read():
            grades, at = all_grades[rows], np.arange(len(sizes))
            scores = np.add.reduceat(scaled[index] * value, np.cumsum(sizes) - sizes)
            below = np.zeros((len(sizes), n_grades + 1))
            below[:, -1] = 1.0
            below[:, 1:-1] = _sigmoid(thresholds[None, :] - scores[:, None])
            slope = below * (1 - below)
            chance = np.maximum(below[at, grades + 1] - below[at, grades], 1e-9)
            pull = (slope[at, grades + 1] - slope[at, grades]) / chance
            by_weight += np.bincount(index, weights=value * np.repeat(pull, sizes), minlength=FEATURES)
            for j in range(n_grades - 1):
                by_threshold[j] += ((np.where(grades == j + 1, slope[:, j + 1], 0) - np.where(grades == j, slope[:, j + 1], 0)) / chance).sum()
        gradient = np.concatenate([by_weight * scale / n + PENALTY * weights, by_threshold / n])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, thresholds = weights - move[:FEATURES], np.maximum.accumulate(thresholds - move[FEATURES:])
    return OrdinalModel((weights * scale).astype(np.float32), thresholds)


def train(labelled: DataFrame, n_grades: int) -> OrdinalModel:
    """A model from `text` and `grade` (0 to `n_grades` - 1) rows; rows without a grade are left out.

    Without any labelled row, every text gets the same score.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            found = [features(t) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0)] + [pa.array([f[i].tobytes() for f in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(2)], names=["grade", "index", "value", "order"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_table()
        sample = _Sample()
        with sample.file:
            for batch in batches:
                for grade, index, value in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    sample.add(np.frombuffer(index.as_py(), dtype=np.int32), np.frombuffer(value.as_py(), dtype=np.float32), grade)
            sample.close_block()
            if sample.grades:
                model = _descend(sample, n_grades)
                yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tobytes()]})

    known = labelled.where(F.col("grade").between(0, n_grades - 1)).select(F.col("grade").cast("int").alias("grade"), "text", "order")
    # the last hash of the sample comes first, so that only the sample's texts are read into features
    last = known.select("order").orderBy("order").limit(TRAINING_ROWS).agg(F.max("order")).first()[0]
    if last is None:
        return OrdinalModel(np.zeros(FEATURES, dtype=np.float32), np.zeros(n_grades - 1))
    fitted = (
        known.where(F.col("order") <= last)
        .select("grade", "text", "order")
        .mapInArrow(read, "grade int, index binary, value binary, order long")
        .repartition(1)
        .sortWithinPartitions("order", "grade", "index", "value")  # sums do not depend on arrival
        .mapInArrow(learn, "weights binary, thresholds binary")
        .first()
    )
    return OrdinalModel(np.frombuffer(bytes(fitted.weights), dtype=np.float32), np.frombuffer(bytes(fitted.thresholds)))


def grade_column(spark: SparkSession, model: OrdinalModel, text: Column) -> Column:
    """`expected_grade` and `top_chance` (of the highest grade) of a text, as a struct; a null text is graded by the constant."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_grade: double, top_chance: double>")
    def grade(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        tails = model.tails(np.array([model.score(t) for t in texts]))
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "top_chance": tails[:, -1]})

    return grade(text)


def grade_documents(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """`docs` with all rows and columns plus `expected_grade` and `top_chance`; columns of these names are replaced."""
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("expected_grade", "top_chance")]
    graded = docs.select(*names, grade_column(docs.sparkSession, model, F.col("text")).alias("__grade"))
    return graded.select(*names, "__grade.expected_grade", "__grade.top_chance")


def select_documents(docs: DataFrame, model: OrdinalModel, chance: float) -> DataFrame:
    """The rows of `docs`, as they are, whose chance of the highest grade is `chance` or more."""
    return docs.where(grade_column(docs.sparkSession, model, F.col("text"))["top_chance"] >= chance)


def graded_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`text`, `grade` and `order` (a hash of the id) of the labelled documents.

    A document with a toxic label has grade 0, one of low quality 1, a good one 2; where labels of one
    id disagree the lowest counts. Labels with a null id, or with neither part, are left out.
    """
    grade: Column = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    found = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))
    order = F.xxhash64("doc_id")
    last = F.col("grade").isNotNull()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(found.where(last), "doc_id").select("text", "grade", order.alias("order"))
