"""Quality classifier from positives and unlabelled text (positive-unlabelled learning).

A linear model over plain measures of a text is fitted to the non-negative
unbiased risk: with trusted positives P, all documents U and the share of
positives in them (the class prior),

    risk = prior * mean_P[log(1 + e^-g)] + max(0, mean_U[log(1 + e^g)] - prior * mean_P[log(1 + e^g)])

No label but trusted positives enters it, nor the class prior: that is read
off the scores of a first fit, as the least share of unlabelled over positive
documents above any score, where a bound on its error is least (best bin).
While the second part is above zero, the risk is convex and Newton steps find its minimum; a step that would
push it below zero is shortened, as that is where a model starts to fit the
positives by heart. Every step sums over all documents where they lie, and
brings a few hundred numbers to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import slices, store

THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
RIDGE = 1e-3
MOST_STEPS = 25
#: Tasks that add up the sums of the others.
SUMMING = 16
#: Steps of the scale of scores, in log odds, on which the class prior is read off.
LEVELS, SPAN = 2048, 16.0
#: The prior of the first fit, whose ranks alone are used.
FIRST_PRIOR = 0.5

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "stop": b".,;:?",
    "shout": b"!",
    "symbol": b"#$%&*+/<=>@\\^_`{|}~",
    "quote": b"\"'()[]-",
    "wide": range(0x80, 0x100),
}
_MEMBERS = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _MEMBERS[list(_bytes), _k] = 1
_BLANK = np.zeros(256)
_BLANK[[0x20, *range(0x09, 0x0E)]] = 1
#: Share below which a class of letters hardly shows.
_FAINT = 1e-3


def text_measures(texts: list[bytes]) -> np.ndarray:
    """One row per text: shares of classes of bytes, repetition, and sizes of words and lines."""
    counts = np.zeros((len(texts), 256))
    shape = np.zeros((len(texts), 4))
    for t, text in enumerate(texts):
        if text:
            counts[t] = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            words, lines = text.split(), text.split(b"\n")
            shape[t] = len(words), len(set(words)), len(lines), len(set(lines))
    solid = np.maximum(1, counts.sum(1) - counts @ _BLANK)
    shares = counts @ _MEMBERS / solid[:, None]
    n_words, n_distinct, n_lines, n_distinct_lines = shape.T
    some = np.maximum(1, n_words)
    size = np.log1p(n_words)
    fresh = np.log1p(n_distinct) - size
    return np.column_stack(
        [
            shares,
            np.log(shares + _FAINT),
            size,
            size**2,
            fresh,
            fresh * size,
            np.log(solid / some),
            np.log1p(n_lines) - size,
            np.log1p(n_distinct_lines) - np.log1p(n_lines),
            n_words == 0,
        ]
    ).astype(np.float64)


WIDTH = text_measures([b""]).shape[1]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``measures`` (array of doubles) of every whole text; null text is empty."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                rows = text_measures(texts)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), WIDTH)
                kept = [batch.column(c).slice(first, len(texts)) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*kept, flat.cast(pa.list_(pa.float64()))], names=[*keep, "measures"]
                )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(measure, f"{kinds}, measures array<double>")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant
    prior: float
    risk: tuple[float, float]

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(rows), -500, 500)))


def _summed(rows: DataFrame, width: int, sums) -> np.ndarray:
    """Sum of ``sums(measures, positives)`` over all batches, added up in two levels."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield sums(_matrix(batch), batch.column("positives").to_numpy())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _packed(sum(vectors(batches), np.zeros(width)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = (x for batch in batches for x in batch.column("sums").to_pylist())
        yield _packed(sum((np.frombuffer(x) for x in blobs), np.zeros(width)))

    parts = rows.select("measures", "positives").mapInArrow(each, "sums binary")
    found = parts.repartition(SUMMING).mapInArrow(merged, "sums binary").collect()
    return sum((np.frombuffer(r.sums) for r in found), np.zeros(width))


def _packed(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["sums"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("measures").flatten().to_numpy().reshape(-1, WIDTH)


def fit(rows: DataFrame, prior: float) -> QualityModel | None:
    """Fit to stored ``measures, positives`` (trusted positive labels of the row); none without positives."""
    moments = _summed(
        rows,
        2 * WIDTH + 2,
        lambda x, p: np.concatenate([x.sum(0), (x**2).sum(0), [len(x), p.sum()]]),
    )
    n_all, n_positive = moments[-2:]
    if not n_positive:
        return None
    mean = moments[:WIDTH] / n_all
    scale = np.sqrt(np.maximum(moments[WIDTH : 2 * WIDTH] / n_all - mean**2, 0))
    scale[scale < 1e-9] = 1
    size = WIDTH + 1

    def pass_over(weights: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        def sums(x: np.ndarray, positives: np.ndarray) -> np.ndarray:
            x = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
            g = x @ weights
            p = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            up = np.logaddexp(0, g)
            return np.concatenate(
                [
                    [up.sum(), positives @ up, positives @ (up - g)],
                    x.T @ p,
                    x.T @ positives,
                    ((x * (p * (1 - p))[:, None]).T @ x).ravel(),
                ]
            )

        found = _summed(rows, 3 + 2 * size + size * size, sums)
        unlabelled, as_negative, as_positive = found[0] / n_all, prior * found[1] / n_positive, prior * found[2] / n_positive
        slope = found[3 : 3 + size] / n_all - prior * found[3 + size : 3 + 2 * size] / n_positive
        curve = found[3 + 2 * size :].reshape(size, size) / n_all
        ridge = np.append(np.full(WIDTH, RIDGE), 0)
        return (
            as_positive + 0.5 * (ridge * weights) @ weights,
            unlabelled - as_negative,
            slope + ridge * weights,
            curve + np.diag(ridge + 1e-9),
        )

    weights = np.zeros(size)
    weights[-1] = np.log(prior / (1 - prior))
    positive_risk, negative_risk, slope, curve = pass_over(weights)
    for _ in range(MOST_STEPS):
        step = np.linalg.solve(curve, slope)
        if slope @ step < 1e-7:
            break
        length = 1.0
        while length > 1e-3:
            ahead = pass_over(weights - length * step)
            if ahead[1] >= 0 and ahead[0] + ahead[1] < positive_risk + negative_risk:
                break
            length /= 2
        else:
            break
        weights = weights - length * step
        positive_risk, negative_risk, slope, curve = ahead
    # Sums of floats depend on their order in the last digits.
    weights = np.array([float(f"{w:.8g}") for w in weights])
    return QualityModel(mean, scale, weights, prior, (positive_risk, negative_risk))


def estimated_prior(rows: DataFrame, model: QualityModel) -> float:
    """Share of positives in all rows, from how ``model`` ranks trusted positives and all rows.

    Above any score, all rows hold at least the prior times the share of the
    positives there. So the least ratio of both shares bounds the prior, and
    meets it where no other rows lie. The score taken is that with the least
    upper bound, so that thin tails do not decide. Kept off 0 and 1.
    """

    def sums(x: np.ndarray, positives: np.ndarray) -> np.ndarray:
        level = (model.log_odds(x) + SPAN) * (LEVELS / (2 * SPAN))
        level = np.clip(np.floor(level), 0, LEVELS - 1).astype(int)
        return np.concatenate([np.bincount(level, w, LEVELS) for w in (None, positives)])

    counts = _summed(rows, 2 * LEVELS, sums).reshape(2, LEVELS)
    totals = counts.sum(1)
    everything, positive = np.cumsum(counts[:, ::-1], 1) / totals[:, None]
    noise = sum(np.sqrt(np.log(40) / (2 * n)) for n in totals)
    some = positive > 0
    ratios = everything[some] / positive[some]
    best = np.argmin(ratios + noise / positive[some])
    return round(min(0.98, max(0.02, ratios[best])), 4)


def _learnt(docs: DataFrame, labels: DataFrame, class_prior: float | None) -> tuple[DataFrame, QualityModel | None]:
    trusted = (
        labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1))
        .groupBy("doc_id").agg(F.count("*").cast("double").alias("_labels"))
    )
    measured = measures(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"])
    rows = store(
        measured.join(trusted, "doc_id", "left").select(
            "doc_id", "measures", F.coalesce("_labels", F.lit(0.0)).alias("positives")
        ),
        "measures",
    )
    if class_prior is not None:
        return rows, fit(rows, class_prior)
    first = fit(rows, FIRST_PRIOR)
    return rows, first and fit(rows, estimated_prior(rows, first))


def _scores(model: QualityModel | None, rows: np.ndarray) -> np.ndarray:
    return model.scores(rows) if model else np.full(len(rows), 0.5)


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, class_prior: float | None = None
) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``.

    Labels of held-out documents are not looked at. Without any trusted
    positive every score is 0.5. Null and empty texts are scored like any
    other; repeated rows get equal scores; an empty table gives no rows; other
    columns are ignored, labels without quality too.
    """
    rows, model = _learnt(docs, labels, class_prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(_scores(model, _matrix(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "score"])

    scored = rows.select("doc_id", "measures").mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def good_documents(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, class_prior: float | None = None
) -> DataFrame:
    """``docs`` that score ``threshold`` or more; texts are measured again where they lie, not joined.

    Without any trusted positive there is no classifier that could reject anything: all documents stay.
    """
    _, model = _learnt(docs, labels, class_prior)
    if model is None:
        return docs

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                good = _scores(model, text_measures(texts)) >= threshold
                yield batch.slice(first, len(texts)).filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
