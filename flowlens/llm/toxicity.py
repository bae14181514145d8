"""Toxicity grades by ordinal regression.

A cumulative-link (proportional odds) model: P(grade >= k) = sigmoid(score - threshold k), one weight
vector for all thresholds, which are kept in order. Features are the distinct words of a text and their runs of
five characters (languages that compound words carry a stem in many forms), as hashed numbers. Only
features that tell grades apart in the sample are fitted, and an L1 penalty drops most of those, so
long texts gather no score from common words. The sample of labelled rows is bounded; every
document is then scored where it is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, staged, text_or_empty

MAX_FIT_ROWS = 20_000  # labelled documents that are fitted on at most
LEAST_DOCUMENTS = 3  # documents of the sample that a feature must occur in
LEAST_Z = 4.0  # standard errors by which a feature's share of toxic documents must differ
PENALTY = 5e-5
STEPS = 800
FEATURE_BITS = 22
BROADCAST_FEATURES = 1_000_000
RUN = 5
_EDGES = ".,;:!?\"'()[]{}<>|*%&$#-_~`«»“”„’…"


def features(text: str) -> set[int]:
    """The distinct words in lower case, without marks at their ends, and their character runs, as numbers."""
    own = set()
    for word in {w.strip(_EDGES) for w in set(text.lower().split())}:
        if len(word) <= RUN:
            own.add(word)
        else:
            marked = f"^{word}$"
            own.update([marked[i:i + RUN] for i in range(len(marked) - RUN + 1)])
            own.add(word)
    own.discard("")
    mask = (1 << FEATURE_BITS) - 1
    return {crc32(x.encode("utf-8", "surrogatepass")) & mask for x in own}


@dataclass
class Ordinal:
    """Shared weights by feature, and ascending thresholds, one per step between grades."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def score(self, text: str) -> float:
        return sum(self.weights[w] for w in features(text) & self.weights.keys())

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return sigmoid(np.asarray(scores)[..., None] - self.thresholds)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def telling(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, least: int = LEAST_DOCUMENTS, z: float = LEAST_Z) -> np.ndarray:
    """The features of at least ``least`` documents whose share of grades above 0 differs from the sample's."""
    size = int(cols.max(initial=0)) + 1
    each = np.bincount(cols, minlength=size)
    toxic = np.bincount(cols, (grades[rows] > 0).astype(float), minlength=size)
    share = (grades > 0).mean() if len(grades) else 0.0
    error = np.sqrt(np.maximum(each * share * (1 - share), 1e-9))
    return np.flatnonzero((each >= least) & (np.abs(toxic - each * share) >= z * error))


def fit(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Ordinal:
    """The penalised maximum likelihood of the cumulative-link model, by accelerated proximal gradient.

    Document ``rows[i]`` has feature ``cols[i]``. Grades are 0, 1, ...; with no rows, or one grade
    alone, there are no weights and no document reaches a step.
    """
    n, top = len(grades), int(grades.max(initial=0))
    if not top or not (grades == 0).any():
        return Ordinal({}, np.array([np.inf]))
    chosen = telling(rows, cols, grades)
    keep = np.isin(cols, chosen)
    rows, cols, m = rows[keep], np.searchsorted(chosen, cols[keep]), len(chosen)
    share = np.array([np.clip((grades >= k).mean(), 1e-6, 1 - 1e-6) for k in range(1, top + 1)])
    thresholds = np.log((1 - share) / share)
    weights = np.zeros(m)
    each = np.bincount(cols, minlength=m)
    # step sizes per feature: the curvature's bound where as many features as the fullest document's share a score
    scale = 4.0 * n / (np.maximum(each, 1) * max(1, np.bincount(rows, minlength=n).max(initial=1)))
    held, moved = weights, weights
    for step in range(steps):
        score = np.bincount(rows, moved[cols], minlength=n)
        above = sigmoid(score[:, None] - thresholds)  # P(grade >= k)
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        low, high = edges[np.arange(n), grades], edges[np.arange(n), grades + 1]
        likely = np.maximum(low - high, 1e-12)
        slope = (low * (1 - low) - high * (1 - high)) / likely  # of the log-likelihood in the score
        gradient = -np.bincount(cols, slope[rows], minlength=m) / n
        raw = moved - scale * gradient
        fresh = np.sign(raw) * np.maximum(np.abs(raw) - scale * penalty, 0)
        moved = fresh + step / (step + 3) * (fresh - held)
        held = fresh
        for k in range(top):  # one damped step per threshold, kept in order
            p = above[:, k] * (1 - above[:, k]) / likely
            pull = (p * (grades == k + 1)).sum() - (p * (grades == k)).sum()
            thresholds[k] -= pull / max(0.25 * n, 1)
        thresholds = np.maximum.accumulate(thresholds)
    return Ordinal({int(w): float(x) for w, x in zip(chosen, held, strict=True) if x}, thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 without toxicity, 1 toxic in a text of good quality, 2 toxic in a poor one.

    Rows with a null label or id are left out; of several labels of a document the gravest counts.
    """
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Ordinal:
    """The model of at most ``max_rows`` labelled documents, those with the least hash of the id.

    Features are counted and chosen where the sample lies; the chosen ones of the bounded sample
    come to the driver.
    """
    order = F.xxhash64(F.lit("fit"), F.col("doc_id"))
    chosen = staged(graded(labels).orderBy(order, "doc_id").limit(max_rows), "sample")
    chosen = F.broadcast(chosen)  # max_rows rows at most
    sample = docs.select("doc_id", text_or_empty("text").alias("text")).join(chosen, "doc_id")

    def numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "features", "grade"])

    found = staged(sample.select(F.col("doc_id").cast("long"), "text", "grade").mapInArrow(numbers, "doc_id long, features array<int>, grade int"), "features")
    sizes = {r["grade"]: r["n"] for r in found.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    share = 1 - sizes.get(0, 0) / n if n else 0.0
    each = found.select("doc_id", "grade", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("grade") > 0).alias("toxic"))
    differs = F.abs(F.col("toxic") - F.col("n") * share) >= LEAST_Z * F.sqrt(F.col("n") * share * (1 - share))
    chosen = staged(counts.where((F.col("n") >= LEAST_DOCUMENTS) & differs).select("feature"), "telling")
    own = each.join(small(chosen, BROADCAST_FEATURES), "feature").groupBy("doc_id", "grade").agg(F.sort_array(F.collect_list("feature")).alias("features"))
    own = own.orderBy("doc_id").toArrow().combine_chunks()
    grades = own.column("grade").to_numpy().astype(np.int64)
    bare = [np.full(k - (grades == g).sum(), g) for g, k in sorted(sizes.items())]  # documents without a telling feature
    lists = own.column("features").combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.int32()))
    rows = np.repeat(np.arange(own.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return fit(rows.astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([grades, *bare]).astype(np.int64))


def scored(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Every row of ``docs``: doc_id, severity (expected grade), grade (the likeliest to be reached) and toxic.

    A null text is empty. Rows are scored one by one; other columns are not read.
    """
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.array([model.score(t) for t in batch.column(1).to_pylist()], np.float64)
            above = model.at_least(raw)
            grade = (above > 0.5).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(grade), pa.array(grade > 0)],
                                             names=["doc_id", "severity", "grade", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(score, "doc_id long, severity double, grade int, toxic boolean")
