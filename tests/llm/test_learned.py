"""Toxicity and quality: held-out accuracy, and inputs without anything to learn from."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import documents, hostile
from pyspark.sql import functions as F

from pageloom.llm import quality, toxicity
from pageloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def rates(spark, name, label):
    got = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    return held.predicted[held[label] == 1].mean(), held.predicted[held[label] == 0].mean(), got


def test_toxicity_held_out(spark):
    hit, wrong, got = rates(spark, "op4_toxicity", "toxic")
    assert hit >= 0.65 and wrong <= 0.02
    assert got.score.between(0, 1).all()


def test_quality_held_out(spark):
    hit, wrong, got = rates(spark, "op9_quality", "quality")
    assert hit >= 0.97 and wrong <= 0.35
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
@pytest.mark.parametrize("kind", ["none", "one class", "nulls"])
def test_little_to_learn(spark, module, label, kind):
    docs = hostile(spark)
    data = {"none": [], "one class": [(3, 1), (4, 1)], "nulls": [(None, 1), (3, None), (3, 1), (3, 0), (0, 0)]}[kind]
    labels = spark.createDataFrame(data, f"doc_id bigint, {label} int")
    model = module.trained(docs, labels, F.lit(True), label)
    out = module.scored(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    same = [r.score for r in out if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]
    assert module.scored(docs.limit(0), model).count() == 0


def test_label_model_finds_the_classes():
    random = np.random.default_rng(1)
    y = random.random(3000) < 0.1
    votes = np.stack([random.random(3000) < np.where(y, 0.5, 0.003) for _ in range(8)], axis=1).astype(float)
    votes = np.c_[votes, votes[:, 0]]  # one voter speaks twice
    posterior, rates_, weight = toxicity.label_model(votes, 0.1)
    assert ((posterior > 0.5) == y).mean() > 0.97
    assert weight[0] < 0.7 and weight[8] < 0.7 and weight[3] > 0.9
    assert np.allclose(rates_[1, 1:8], 0.5, atol=0.12)


def test_stage_keeps_columns(spark):
    docs = documents(spark, ["bad worda wordb", "good text", None] * 20)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id bigint, toxic int")
    model = toxicity.trained(docs, labels, F.lit(True))
    kept = toxicity.kept(docs, model, 0.7)
    assert kept.columns == docs.columns and {r.doc_id % 3 for r in kept.collect()} == {1, 2}


def plain_label_model(votes, prior):
    """The label model, voter by voter and row by row."""
    from math import exp, log, sqrt

    n, m = len(votes), len(votes[0])
    said = [[*row, int(not any(row))] for row in votes]
    posterior = [0.95 if sum(row) >= 2 else 0.5 if sum(row) == 1 else 0.02 for row in votes]
    for _ in range(toxicity.ROUNDS):
        rates = []
        for side, pseudo in ((0, 0.1), (1, 0.5)):
            mass = [p if side else 1 - p for p in posterior]
            rates.append([(sum(w * row[j] for w, row in zip(mass, said, strict=True)) + pseudo) / (sum(mass) + 1) for j in range(m + 1)])
        rates = [[min(max(r, 1e-4), 1 - 1e-4) for r in side] for side in rates]
        for j in range(m):
            rates[1][j] = max(rates[1][j], 2 * rates[0][j])
        rates[0][m] = max(rates[0][m], 2 * min(rates[1][m], 0.5 - 1e-4))
        rest = [[row[j] - p * rates[1][j] - (1 - p) * rates[0][j] for j in range(m + 1)] for row, p in zip(said, posterior, strict=True)]
        spread = [sqrt(sum(r[j] ** 2 for r in rest) / n) + 1e-9 for j in range(m + 1)]
        weight = []
        for j in range(m + 1):
            extra = 0.0
            for k in range(m + 1):
                together = sum(r[j] * r[k] for r in rest) / n / spread[j] / spread[k]
                extra += 0 if j == k else min(max(min(max(together, 0), 1) - toxicity.SAME, 0), 1) / (1 - toxicity.SAME)
            weight.append(1 / (1 + extra) if j < m else 1.0)
        for i, row in enumerate(said):
            logit = log(prior / (1 - prior))
            for j, v in enumerate(row):
                spoken, silent = log(rates[1][j] / rates[0][j]), log((1 - rates[1][j]) / (1 - rates[0][j]))
                logit += weight[j] * (spoken if v else 0.1 * silent)
            posterior[i] = 1 / (1 + exp(-min(max(logit, -12), 12)))
    return posterior, rates, weight


def test_label_model_equals_the_plain_one():
    rng = np.random.default_rng(7)
    for toxic in (0.1, 0.4):
        truth = rng.random(60) < toxic
        votes = (rng.random((60, 5)) < np.where(truth[:, None], 0.6, 0.05)).astype(int)
        votes[:, 4] = votes[:, 3]  # one voice twice
        got = toxicity.label_model(votes, 0.3)
        want = plain_label_model(votes.tolist(), 0.3)
        for a, b in zip(got, want, strict=True):
            assert np.allclose(a, b, atol=1e-9)
        assert got[2][4] < got[2][0] and got[2][4] < 0.8
        assert ((got[0] >= 0.5) == truth).mean() > 0.8


def plain_quality_odds(rows, buckets, dim, epochs, seed=7):
    """The classifier's log-odds of each bucket and bias, number by number."""
    from math import exp, log

    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (buckets, dim)).tolist()
    layer = [[0.0, 0.0] for _ in range(dim)]
    share = min(max(sum(y for *_, y in rows) / len(rows), 0.01), 0.99)
    bias = [log(1 - share), log(share)]
    for epoch in range(epochs):
        for step, i in enumerate(random.permutation(len(rows))):
            bucket, n, y = rows[i]
            rate = quality.RATE * (1 - (epoch + step / len(rows)) / epochs)
            total = sum(n)
            mean = [sum(c / total * vectors[b][d] for b, c in zip(bucket, n, strict=True)) for d in range(dim)]
            logit = [sum(mean[d] * layer[d][k] for d in range(dim)) + bias[k] for k in (0, 1)]
            e = [exp(x - max(logit)) for x in logit]
            p = [x / sum(e) - (k == y) for k, x in enumerate(e)]
            back = [sum(layer[d][k] * p[k] for k in (0, 1)) for d in range(dim)]
            for k in (0, 1):
                for d in range(dim):
                    layer[d][k] -= rate * mean[d] * p[k]
                bias[k] -= 0.1 * rate * p[k]
            for b, c in zip(bucket, n, strict=True):
                for d in range(dim):
                    vectors[b][d] -= rate * min(c, 8) * back[d] / len(bucket) * 16
    return [sum(v[d] * (layer[d][1] - layer[d][0]) for d in range(dim)) for v in vectors], bias[1] - bias[0]


def test_quality_steps_equal_the_plain_ones(monkeypatch):
    for name, value in (("BUCKETS", 40), ("DIM", 4), ("EPOCHS", 6), ("STEPS", 1)):
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(30):
        bucket = np.unique(rng.integers(0, 30, 8) + 10 * (i % 2))
        rows.append((bucket, rng.integers(1, 12, len(bucket)), i % 2))
    model = quality.Model(rows)
    odds, bias = plain_quality_odds([(b.tolist(), n.tolist(), y) for b, n, y in rows], 40, 4, 6)
    assert np.allclose(model.odds, odds, atol=2e-3) and abs(model.bias - bias) < 2e-3
    assert np.abs(odds).max() > 0.1
