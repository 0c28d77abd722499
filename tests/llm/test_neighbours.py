"""Recall of the nearest neighbours at the settings of the query, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import neighbours

RNG = np.random.default_rng(5)


def uniform(n):
    return RNG.normal(size=(n, 64))


def clustered(n):
    return RNG.normal(size=(200, 64))[RNG.integers(0, 200, n)] * 2 + RNG.normal(size=(n, 64)) * 0.4


def of_norms(n):
    return RNG.normal(size=(n, 64)) * RNG.lognormal(0, 1, (n, 1))


def recalls(spark, x, every):
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % every == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = x.astype(np.float64)
    out = []
    for i in range(0, len(x), every):
        scores = x @ x[i]
        scores[i] = -np.inf
        want = set(np.argsort(-scores, kind="stable")[:20].tolist())
        found = sorted(got[i])
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - x[v] @ x[i]) <= 1e-9 * max(1, abs(s)) for _, v, s in found)
        out.append(len(want & {v for _, v, _ in found}) / 20)
    return np.array(out)


@pytest.mark.parametrize("made,n", [(uniform, 30_000), (clustered, 12_000), (of_norms, 12_000)])
def test_recall_at_the_defaults(spark, made, n):
    found = recalls(spark, made(n), 100)
    print(made.__name__, n, found.mean(), found.min())
    assert found.mean() >= 0.95 and found.min() >= 0.6


def test_components_of_any_finite_size(spark):
    rows = [(i, [10.0**300 * (i % 7 + 1), 10.0**300 * (i % 3 - 1)]) for i in range(0, 50)] + [(100, [1e-300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in found} == {0, 100} and len(found) == 40
    small = spark.createDataFrame([(i, [1e-30 * (i + 1), 1e-30]) for i in range(40)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in neighbours.search(small, F.col("vec_id") == 0).orderBy("rank").collect()] == list(range(39, 19, -1))
