"""Held-out accuracy, the prior, and that held-out labels change nothing."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm.common import table
from siftline.llm.quality import THRESHOLD, WIDTH, good_documents, quality_scores, text_measures

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return quality_scores(table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")).toPandas()


def area(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    good = label == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_documents(spark, scored):
    labels = table(spark, SF_DIR, "labels").toPandas().dropna(subset=["quality"])
    both = scored.merge(labels, on="doc_id")
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in scored.doc_id]).all()
    tested = both[both.held_out]
    assert len(tested) > 500
    assert area(tested.score.to_numpy(), tested.quality.to_numpy()) > 0.97
    assert (tested.predicted == tested.quality).mean() > 0.96
    good = tested[tested.quality == 1]
    assert good.predicted.mean() > 0.97
    assert ((scored.score >= THRESHOLD) == (scored.predicted == 1)).all()
    assert scored.score.between(0, 1).all()


def test_held_out_labels_and_other_columns_are_not_looked_at(spark, scored):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    hidden = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("quality", F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "score": F.lit(3), "measures": F.lit("m")})
    again = quality_scores(other, turned).toPandas()
    both = scored.merge(again, on="doc_id")
    assert np.allclose(both.score_x, both.score_y, atol=1e-6)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (2, ""), (None, "no id"), (3, "plain words here. " * 20000), (4, "x###" * 50), (5, "\n\n")],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(3, 1), (4, 0), (1, None), (None, 1), (99, 1)], "doc_id long, quality int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    none = labels.where("false")
    assert {(r.score, r.predicted) for r in quality_scores(docs, none).collect()} == {(0.5, 0)}
    assert good_documents(docs, none).count() == 7  # nothing was rejected by a classifier
    empty = docs.where("false")
    assert quality_scores(empty, labels).collect() == []


def test_kept_documents(spark, scored):
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    docs = docs.withColumns({"measures": F.lit("m"), "positives": F.lit(1)})
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(scored.doc_id[scored.predicted == 1])


def test_measures_are_finite():
    rows = text_measures([b"", b" ", b"word", b"\xff" * 10, b"a\n" * 1000, ("É " * 500).encode()])
    assert rows.shape == (6, WIDTH) and np.isfinite(rows).all()


def plain_fit(x, positives, prior, ridge, newton=True):
    """The same risk on one matrix, by Newton or gradient steps without a look at its negative part."""
    mean, scale = x.mean(0), x.std(0)
    z = np.column_stack([np.clip((x - mean) / np.where(scale < 1e-9, 1, scale), -8, 8), np.ones(len(x))])
    w, pull = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 0)
    w[-1] = np.log(prior / (1 - prior))
    for _ in range(60 if newton else 3000):
        p = 1 / (1 + np.exp(-z @ w))
        slope = z.T @ p / len(z) - prior * z.T @ positives / positives.sum() + pull * w
        if not newton:
            w = w - 0.05 * slope
            continue
        w = w - 0.5 * np.linalg.solve((z.T * (p * (1 - p))) @ z / len(z) + np.diag(pull + 1e-9), slope)
    up = np.logaddexp(0, z @ w)
    return 1 / (1 + np.exp(-z @ w)), up.mean() - prior * positives @ up / positives.sum()


def test_risk_equals_a_plain_minimisation(spark):
    from siftline.llm import quality

    rng = np.random.default_rng(3)
    n = 1500
    good = rng.random(n) < 0.5
    x = rng.normal(size=(n, WIDTH)) + np.outer(good, np.linspace(0, 0.5, WIDTH))
    positives = (good & (rng.random(n) < 0.4)).astype(float)
    rows = spark.createDataFrame(
        [(i, x[i].tolist(), float(positives[i])) for i in range(n)], "doc_id long, measures array<double>, positives double"
    ).repartition(3)
    model = quality.fit(rows, 0.5)
    scores, negative = plain_fit(x, positives, 0.5, quality.RIDGE)
    assert negative > 0 and np.abs(model.scores(x) - scores).max() < 2e-3
    # A prior far too high: the plain minimum has a negative risk below 0, the model must not go there.
    held = quality.fit(rows, 0.95)
    assert plain_fit(x, positives, 0.95, quality.RIDGE, newton=False)[1] < 0 <= held.risk[1]


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_without_labels_of_the_other_class(spark, share):
    from siftline.llm import quality

    rng = np.random.default_rng(11)
    n = 6000
    good = rng.random(n) < share
    x = rng.normal(size=(n, WIDTH)) + np.outer(good, np.linspace(0.5, 1.2, WIDTH))
    positives = (good & (rng.random(n) < 0.3)).astype(float)
    rows = spark.createDataFrame(
        [(i, x[i].tolist(), float(positives[i])) for i in range(n)], "doc_id long, measures array<double>, positives double"
    ).repartition(3)
    found = quality.estimated_prior(rows, quality.fit(rows, quality.FIRST_PRIOR))
    assert abs(found - good.mean()) < 0.05


def test_prior_of_the_documents(spark, scored):
    """The documents' own share of ones, which the estimate has not seen; labels of class 0 change nothing."""
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    ones = quality_scores(docs, labels.where("quality = 1")).toPandas().merge(scored, on="doc_id")
    assert np.allclose(ones.score_x, ones.score_y, atol=1e-6)
    from siftline.llm import quality

    rows, model = quality._learnt(docs, labels, None)
    share = labels.where("quality is not null").agg(F.avg("quality")).first()[0]
    assert abs(model.prior - share) < 0.05, (model.prior, share)
