"""Toxicity as an ordinal severity: cumulative-link regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector for all thresholds theta_0 < theta_1 < ...
The expected severity is the sum of P(grade > k). Features are words, their beginnings and their ends,
those that the labelled rows show to be far more frequent in toxic texts; x is log(1 + count).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.common import materialize, release, small_batches

#: Labelled rows that a model is fitted on at most; the choice is by hash of the id.
SAMPLE = 20_000
#: Features that a model has at most, documents that must hold one, and how much more frequent it must be in toxic ones.
FEATURES, MIN_DOCS, MIN_LIFT = 2048, 5, 4.0
#: Severity grades: 0, not toxic, and the toxic ones in thirds by how often they hold the features.
GRADES = 4
AFFIXES = (4, 5)
#: Words whose features a worker keeps.
CACHE_WORDS = 100_000
_WORD = re.compile(r"\w+")


def word_features(word: str) -> tuple[int, ...]:
    """64-bit hashes of the word, its beginnings and its ends."""
    parts = [f"w{word}"]
    for n in AFFIXES:
        if len(word) > n:
            parts += (f"b{word[:n]}", f"e{word[-n:]}")
    return tuple(np.array([xxhash.xxh64_intdigest(p.encode()) for p in parts], np.uint64).view(np.int64).tolist())


class _Cache(dict):
    """Words to what ``make`` gives for them."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.make(word)
        return found


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _near_groups(batches):
    """For ``mapInArrow``: adds the smallest hash of the text's shingles, which near copies mostly share."""
    for batch in batches:
        group = []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            shingles = {" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))}
            group.append(min(xxhash.xxh64_intdigest(s.encode()) for s in shingles) >> 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group, pa.int64())], [*batch.schema.names, "near"])


def _features_of(batches):
    """For ``mapInArrow`` over texts: their distinct features, one row each."""
    cache = _Cache(word_features)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            found = set().union(*map(cache.__getitem__, set(words_of(text))))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64())], ["feature"])


def _documents_with(numbers: dict[int, int]):
    """For ``mapInArrow`` over texts: how many hold each of some features, summed up per task."""
    count = Counts(numbers)

    def run(batches):
        held = np.zeros(len(numbers), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held[list(count(text))] += 1
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], ["number", "docs"])

    return run


def _feature_counts(numbers: dict[int, int]):
    """For ``mapInArrow``: (id, toxic, severity, feature numbers, counts) of each text, chosen features only."""
    count = Counts(numbers)

    def run(batches):
        for batch in batches:
            found = [count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "toxic", "severity")),
                    pa.array([list(f) for f in found], pa.list_(pa.int32())),
                    pa.array([list(f.values()) for f in found], pa.list_(pa.int32())),
                ],
                ["id", "toxic", "severity", "features", "counts"],
            )

    return run


class Counts:
    """How often a text holds each chosen feature, by feature number."""

    def __init__(self, numbers: dict[int, int]):
        self.numbers = numbers
        self.cache: _Cache | None = None  # not sent along with the object

    def __getstate__(self):
        return {"numbers": self.numbers, "cache": None}

    def _of_word(self, word: str) -> tuple[int, ...]:
        return tuple(self.numbers[f] for f in word_features(word) if f in self.numbers)

    def __call__(self, text: str | None) -> dict[int, int]:
        if self.cache is None:
            self.cache = _Cache(self._of_word)
        out: dict[int, int] = {}
        for numbers in filter(None, map(self.cache.__getitem__, words_of(text))):
            for n in numbers:
                out[n] = out.get(n, 0) + 1
        return out


@dataclass(frozen=True)
class SeverityModel:
    numbers: dict[int, int]  # feature hash to its place in ``weights``
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than there are grades

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k, from the linear scores."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -40, 40)))

    def score(self, counts: dict[int, int]) -> float:
        return float(sum(self.weights[n] * np.log1p(c) for n, c in counts.items()))


def fit_cumulative_link(rows: list[tuple[list[int], list[int]]], grades: np.ndarray, features: int, n_grades: int, rounds: int = 400, l2: float = 1e-3):
    """(weights, thresholds) by gradient descent (Adam) on the log-likelihood of the cumulative-link model.

    rows: feature numbers and counts of each row. Thresholds are kept in order as a first one and positive steps.
    """
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feature = np.array([k for f, _ in rows for k in f], np.int64)
    value = np.log1p(np.array([c for _, cs in rows for c in cs], float))
    n, k = len(rows), n_grades - 1
    p = np.concatenate([np.zeros(features), [1.0], np.full(k - 1, 0.5)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    at = np.arange(n)
    for t in range(1, rounds + 1):
        w, steps = p[:features], np.exp(p[features + 1 :])
        theta = p[features] + np.concatenate([[0], np.cumsum(steps)])
        eta = np.bincount(row, w[feature] * value, n)
        below = np.concatenate([np.zeros((n, 1)), sig(theta[None, :] - eta[:, None]), np.ones((n, 1))], axis=1)
        hi, lo = below[at, grades + 1], below[at, grades]
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / prob / n, lo * (1 - lo) / prob / n
        g_theta = np.zeros(k)
        np.add.at(g_theta, grades[grades < k], -d_hi[grades < k])
        np.add.at(g_theta, grades[grades > 0] - 1, d_lo[grades > 0])
        g_eta = d_hi - d_lo
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(feature, g_eta[row] * value, features) + l2 * w / max(1, features) ** 0.5, [tail[0]], tail[1:] * steps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return p[:features], p[features] + np.concatenate([[0], np.cumsum(np.exp(p[features + 1 :]))])


def _gain(yes: int, no: int, toxic: int, clean: int) -> float:
    """Log-likelihood gained by a frequency of its own in toxic texts; 0 if that is not much higher than in clean ones."""
    if (yes + 0.5) / toxic < MIN_LIFT * (no + 0.5) / clean:
        return 0.0
    both = (yes + no) / (toxic + clean)
    return yes * np.log(yes / toxic / both) + (no * np.log(no / clean / both) if no else 0.0)


def fit_severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, n_grades: int = GRADES, features: int = FEATURES) -> SeverityModel:
    """Fits a model of ``features`` features at most, those that tell most, on ``sample`` labelled rows at most.

    labels: the id column, toxic 0/1 and, if there is one, severity (0 to n_grades - 1). Without a severity
    the toxic rows are graded in parts of equal size by how often they hold the chosen features. Rows with a null
    id or label are left out; the highest label of an id counts; near copies count once. Without
    features or without both classes the model gives every text the same low severity.
    """
    spark = docs.sparkSession
    small_batches(spark)
    graded = F.col("severity").cast("int") if "severity" in labels.columns else F.lit(None).cast("int")
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"), graded.alias("severity"))
        .filter("id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"), F.max("severity").alias("severity"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    # `sample` rows of three numbers at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.select("id", "toxic", "severity", "text").mapInArrow(_near_groups, f"id {kind}, toxic int, severity int, text string, near long")
    rows = materialize(rows, "toxicity-sample")
    first = rows.groupBy("near", "toxic").agg(F.min("id").alias("id")).select("id")
    rows = materialize(rows.join(first, "id", "left_semi").select("id", "toxic", "severity", "text"), "toxicity-distinct")
    totals = rows.groupBy("toxic").count().collect()  # two rows
    n = {r.toxic: r["count"] for r in totals}
    if len(n) < 2:
        return SeverityModel({}, np.zeros(0), np.arange(1, n_grades) * 10.0)
    # all features of the toxic texts that are frequent enough, then how many other texts hold them: bounded, as the sample is
    seen = rows.filter("toxic = 1").select("text").mapInArrow(_features_of, "feature long").groupBy("feature").count()
    yes = {r.feature: r["count"] for r in seen.filter(F.col("count") >= MIN_DOCS).orderBy("feature").collect()}
    numbers = {f: k for k, f in enumerate(yes)}
    held = rows.filter("toxic = 0").select("text").mapInArrow(_documents_with(numbers), "number long, docs long")
    no = {r.number: r.docs for r in held.groupBy("number").agg(F.sum("docs").alias("docs")).collect()}
    best = sorted((-g, f) for f, k in numbers.items() if (g := _gain(yes[f], no.get(k, 0), n[1], n[0])) > 0)[:features]
    numbers = {f: k for k, (_, f) in enumerate(best)}
    counted = rows.mapInArrow(_feature_counts(numbers), f"id {kind}, toxic int, severity int, features array<int>, counts array<int>")
    data = sorted(counted.collect(), key=lambda r: str(r.id))  # `sample` rows of ``features`` numbers at most, mostly none
    amount = np.array([sum(r.counts) for r in data])
    toxic = np.array([r.toxic for r in data])
    cuts = np.quantile(amount[toxic > 0], np.arange(1, n_grades - 1) / (n_grades - 1))
    grades = np.where(toxic > 0, 1 + np.searchsorted(cuts, amount, "right"), 0)
    grades = np.array([g if r.severity is None else min(max(r.severity, 0), n_grades - 1) for g, r in zip(grades.tolist(), data, strict=True)])
    weights, thresholds = fit_cumulative_link([(r.features, r.counts) for r in data], grades, len(numbers), n_grades)
    return SeverityModel(numbers, weights, thresholds)


def score_severity(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, expected_severity, grade (the most likely one), toxic (grade 1 or more is likelier than not).

    Whole texts are scored in the scan, without a shuffle. Null texts count as empty; null or repeated ids
    are carried along; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    count = Counts(model.numbers)

    def run(batches):
        for batch in batches:
            x = np.array([model.score(count(t)) for t in batch.column("text").to_pylist()])
            above = model.above(x)
            at_least = np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], axis=1)
            grade = np.argmax(at_least[:, :-1] - at_least[:, 1:], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] >= 0.5)],
                ["id", "expected_severity", "grade", "toxic"],
            )
        count.cache = None
        release()

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, expected_severity double, grade int, toxic boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model does not find toxic, columns unchanged.

    Defined cases: a null text counts as empty, and null or repeated ids and columns of any name pass through; rows that repeat go or stay
    together; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    count = Counts(model.numbers)

    def run(batches):
        for batch in batches:
            x = np.array([model.score(count(t)) for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array(model.above(x)[:, 0] < 0.5))
        count.cache = None
        release()

    return docs.mapInArrow(run, docs.schema)
