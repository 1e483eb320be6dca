"""Consensus labels, agreement and annotator reliability from disagreeing annotators.

Model: an item has a true grade drawn from the class weights; an annotator with true grade
``k`` in front gives grade ``g`` with the annotator's own probability.  Class weights and each
row of each annotator's confusion table have Dirichlet priors (the diagonal weighs more).
Mean-field variational inference alternates between the posterior of every item's grade and
the Dirichlet posteriors, whose expected logarithms are digamma differences.  Items are one
row each (arrays of annotators and grades) in a written table; a round is one pass over it
that sums expected counts inside each partition, and a group-by over (annotator, true grade,
given grade) that adds up the partitions.  Only those sums reach the driver; their number,
annotators x grades^2, is checked.

Defined results
---------------
* Null labels, null queries or paragraphs, sessions without annotators and null or blank
  annotator ids do not count.  Ids differing in case or outer blanks are one person.
* Of a person's labels for an item the one with the latest ``time_stamp`` counts (null is
  earliest; then the later ``loaded_at``, then the higher grade).
* Ties between posterior grades go to the lower grade.  An item's agreement is 1 - its mean
  squared label difference / the expected one (Krippendorff's alpha restricted to the item);
  null with fewer than two labels or if all labels of all items are equal.
* Empty tables give empty results.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

MOST_COUNTS = 20_000_000  # annotators x grades^2 that fit a task and the driver
PRIOR_CLASS, PRIOR_RIGHT, PRIOR_WRONG = 1.0, 2.0, 0.35
MOST_ROUNDS, TOLERANCE = 60, 2e-4


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 8 and the asymptotic series beyond."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        out[low] -= 1 / x[low]
        x[low] += 1
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))


def person_labels(assessments: DataFrame, metadata: DataFrame) -> DataFrame:
    """(query_id, paragraph_id, annotator, relevance): one label per item and person."""
    name = F.lower(F.regexp_replace("a", r"(?U)^\s+|\s+$", ""))
    people = metadata.where("session_id IS NOT NULL").select("session_id", F.explode("annotator_ids").alias("a")).where("a IS NOT NULL").select("session_id", name.alias("annotator")).where("annotator <> ''").distinct()
    rows = assessments.where("relevance IS NOT NULL AND query_id IS NOT NULL AND paragraph_id IS NOT NULL").select("query_id", "paragraph_id", "session_id", "relevance", "time_stamp", "loaded_at")
    return rows.join(people, "session_id").groupBy("query_id", "paragraph_id", "annotator").agg(F.max(F.struct("time_stamp", "loaded_at", "relevance"))["relevance"].alias("relevance"))


@dataclass
class Fit:
    items: DataFrame  # query_id, paragraph_id, people array<int>, given array<int>
    people: list[str]
    grades: list[int]
    class_counts: np.ndarray  # Dirichlet posterior of the class weights
    counts: np.ndarray  # (annotator, true, given) Dirichlet posteriors
    expected: float | None  # expected squared difference of two labels


def _log_tables(class_counts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return digamma(class_counts) - digamma(class_counts.sum()), digamma(counts) - digamma(counts.sum(axis=2, keepdims=True))


def _posterior(people: np.ndarray, given: np.ndarray, sizes: np.ndarray, log_class: np.ndarray | None, log_table: np.ndarray, grades: int) -> np.ndarray:
    """(items, grades); with ``log_class`` None the share of each grade among an item's labels."""
    begins = np.cumsum(sizes) - sizes
    if log_class is None:
        votes = np.zeros((len(sizes), grades))
        np.add.at(votes, (np.repeat(np.arange(len(sizes)), sizes), given), 1)
        return (votes + 0.1) / (votes + 0.1).sum(axis=1, keepdims=True)
    score = np.add.reduceat(log_table[people, :, given], begins, axis=0) + log_class
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(axis=1, keepdims=True)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("people")
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(), batch.column("given").flatten().to_numpy(), sizes


def fit(labels: DataFrame) -> Fit:
    spark = labels.sparkSession
    labels = materialize(labels, "labels")
    a, k = labels.agg(F.count_distinct("annotator"), F.count_distinct("relevance")).first()
    if a * k * k > MOST_COUNTS:
        raise ValueError(f"{a} annotators and {k} grades exceed {MOST_COUNTS} confusion counts")
    people = sorted(labels.select("annotator").distinct().toArrow()["annotator"].to_pylist())
    grades = sorted(labels.select("relevance").distinct().toArrow()["relevance"].to_pylist())
    number = spark.createDataFrame(pa.table({"person": pa.array(range(a), pa.int32()), "annotator": pa.array(people, pa.string())}))
    position = F.array_position(F.array(*[F.lit(g) for g in grades]), F.col("relevance")) - 1 if grades else F.lit(0)
    items = (
        labels.join(number, "annotator")
        .groupBy("query_id", "paragraph_id")
        .agg(F.array_sort(F.collect_list(F.struct("person", position.cast("int").alias("given")))).alias("l"))  # one label a person at most
        .select("query_id", "paragraph_id", F.col("l.person").alias("people"), F.col("l.given").alias("given"))
    )
    items = materialize(items, "items")
    if not people:
        return Fit(items, [], [], np.empty(0), np.empty((0, 0, 0)), None)
    prior = np.where(np.eye(k, dtype=bool), PRIOR_RIGHT, PRIOR_WRONG)
    table, class_counts, counts = None, None, None
    for _ in range(MOST_ROUNDS):
        shared = spark.sparkContext.broadcast(table)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            log_class, log_table = shared.value if shared.value else (None, None)
            total, classes = np.zeros((a, k, k)), np.zeros(k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                who, given, sizes = _arrays(batch)
                p = _posterior(who, given, sizes, log_class, log_table, k)
                classes += p.sum(axis=0)
                each = np.repeat(p, sizes, axis=0)
                cell = who.astype(np.int64) * k + given
                for c in range(k):
                    total[:, c, :] += np.bincount(cell, each[:, c], a * k).reshape(a, k)
            flat = np.r_[total.ravel(), classes]
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["cell", "weight"])

        sums = items.select("people", "given").mapInArrow(count, "cell bigint, weight double").groupBy("cell").agg(F.sum("weight").alias("weight")).toArrow()
        flat = np.zeros(a * k * k + k)
        flat[sums["cell"].to_numpy()] = sums["weight"].to_numpy()
        new = flat[: a * k * k].reshape(a, k, k) + prior
        moved = np.inf if counts is None else np.abs(new - counts).max() / max(1.0, flat[a * k * k :].sum())
        counts, class_counts = new, flat[a * k * k :] + PRIOR_CLASS
        table = _log_tables(class_counts, counts)
        shared.unpersist()
        if moved < TOLERANCE / a:
            break
    else:
        warnings.warn(f"no convergence after {MOST_ROUNDS} rounds; the counts last moved by {moved:.2g} of the items", stacklevel=2)
    return Fit(items, people, grades, class_counts, counts, _expected_difference(items, grades))


def _expected_difference(items: DataFrame, grades: list[int]) -> float | None:
    """Mean squared difference of two labels of items with at least two, drawn at random."""
    rows = items.where(F.size("given") > 1).select(F.explode("given").alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()
    n = sum(r["n"] for r in rows)
    total = sum(x["n"] * y["n"] * (grades[x["g"]] - grades[y["g"]]) ** 2 for x in rows for y in rows)
    return total / (n * (n - 1)) if total else None


def consensus(model: Fit) -> DataFrame:
    """query_id, paragraph_id, relevance, confidence, n_labels, agreement."""
    spark = model.items.sparkSession
    out = "query_id string, paragraph_id string, relevance int, confidence double, n_labels int, agreement double"
    if not model.people:
        return spark.createDataFrame([], out)
    tables = spark.sparkContext.broadcast(_log_tables(model.class_counts, model.counts))
    grades, expected, k = np.array(model.grades), model.expected, len(model.grades)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            who, given, sizes = _arrays(batch)
            p = _posterior(who, given, sizes, *tables.value, k)
            best = p.argmax(axis=1)
            value = grades[given].astype(float)
            begins = np.cumsum(sizes) - sizes
            s1, s2 = np.add.reduceat(value, begins), np.add.reduceat(value * value, begins)
            several = sizes > 1
            differ = 2 * (sizes * s2 - s1 * s1) / np.maximum(sizes * (sizes - 1), 1)
            agreement = pa.array(1 - differ / expected if expected else np.zeros(len(sizes)), mask=~several if expected else np.ones(len(sizes), bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), batch.column("paragraph_id"), pa.array(grades[best].astype(np.int32)), pa.array(p[np.arange(len(best)), best]), pa.array(sizes.astype(np.int32)), agreement],
                names=[x.split()[0] for x in out.split(", ")],
            )

    return model.items.mapInArrow(work, out)


def reliability(model: Fit) -> DataFrame:
    """annotator, n_labels, reliability and its 95 % interval: the chance of giving the true grade, over the class weights.

    Each confusion row is a Dirichlet posterior; its diagonal is a Beta variable with known
    mean and variance, and rows are independent.
    """
    spark = model.items.sparkSession
    out = "annotator string, n_labels bigint, reliability double, low double, high double"
    rows = []
    prior_total = PRIOR_RIGHT + PRIOR_WRONG * (len(model.grades) - 1)
    for name, c in zip(model.people, model.counts):
        total, right = c.sum(axis=1), np.diag(c)
        weight = model.class_counts / model.class_counts.sum()
        mean = right / total
        spread = float(np.sqrt((weight**2 * mean * (1 - mean) / (total + 1)).sum()))
        m = float((weight * mean).sum())
        rows.append((name, round(float(total.sum() - prior_total * len(total))), m, max(0.0, m - 1.96 * spread), min(1.0, m + 1.96 * spread)))
    return spark.createDataFrame(rows, out)


def krippendorff(labels: DataFrame) -> DataFrame:
    """One row: n_items, n_labels, alpha (interval metric) over items with at least two labels; alpha null if undefined."""
    v = F.col("relevance").cast("double")
    items = labels.groupBy("query_id", "paragraph_id").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")).where("n > 1")
    t = items.agg(F.count("*").alias("n_items"), F.sum("n").alias("n_labels"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(2 * (F.col("n") * F.col("ss") - F.col("s") ** 2) / (F.col("n") - 1)).alias("d"))
    seen = F.col("d") / F.col("n_labels")
    chance = 2 * (F.col("n_labels") * F.col("ss") - F.col("s") ** 2) / (F.col("n_labels") * (F.col("n_labels") - 1))
    return t.select("n_items", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.when(chance > 0, 1 - seen / chance).alias("alpha"))
