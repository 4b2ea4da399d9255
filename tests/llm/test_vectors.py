from __future__ import annotations

import numpy as np
import pytest
from helpers import HERE, SF
from pyspark.sql import functions as F

from pageloom.llm import vector_search
from pageloom.llm.queries import QUERIES

KIND = "vec_id bigint, embedding array<float>, label int, rep string, query string, ids string, vector string, near string"


def table(spark, ids, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, *["x"] * 5) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, KIND)


def brute(ids, vectors, k=20, step=20):
    """{query: [(vec_id, score), ...]}, nearest first, ties to the smaller id."""
    m = np.array(vectors, dtype=np.float32).astype(float)
    out = {}
    for i, v in zip(ids, m, strict=True):
        if i % step == 0:
            near = sorted(((-float(s), j) for j, s in zip(ids, m @ v, strict=True) if j != i))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for near in out.values():
        near.sort()
        assert [n[0] for n in near] == list(range(1, len(near) + 1))
    return {q: [n[1:] for n in near] for q, near in out.items()}


def recall(got, want):
    hits = sum(len({j for j, _ in near} & {j for j, _ in got[q]}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


def check(got, want, least):
    assert got.keys() == want.keys()
    for q, near in got.items():
        exact = dict(want[q])
        assert len(near) == len(want[q]) and len({j for j, _ in near}) == len(near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(j not in exact or abs(s - exact[j]) < 1e-9 for j, s in near)
    assert recall(got, want) >= least


@pytest.fixture(scope="module")
def random_rows():
    rng = np.random.default_rng(3)
    loose = rng.standard_normal((1_500, 48))
    tight = rng.standard_normal(48) + 0.01 * rng.standard_normal((500, 48))
    return list(range(2_000)), np.concatenate([loose, tight]).tolist()


def test_recall(spark, random_rows, monkeypatch):
    """Several blocks of codes and queries, lengths that differ, a group of almost equal vectors."""
    monkeypatch.setattr(vector_search, "CODES_AT_ONCE", 300)
    monkeypatch.setattr(vector_search, "QUERIES_AT_ONCE", 30)
    ids, vectors = random_rows
    got = found(vector_search.nearest(table(spark, ids, vectors), F.col("vec_id") % 20 == 0))
    check(got, brute(ids, vectors), 0.97)


def test_estimates_are_unbiased_within_their_errors(random_rows):
    m = np.array(random_rows[1])
    code = vector_search.coder(m[::3])
    near, bits, numbers = code.coded(m)
    signs = np.unpackbits(bits, axis=1) * 2.0 - 1
    q = m[:100]
    estimate = (q @ code.centres.T)[:, near] + numbers[:, 1] + numbers[:, 0] * ((q @ code.turn) @ signs.T)
    away = np.linalg.norm(q[:, None] - code.centres, axis=2)[:, near]
    spread = numbers[:, 2] * away  # none for a vector, or a query, that is a centre
    errors = ((estimate - q @ m.T)[spread > 1e-9]) / spread[spread > 1e-9]
    assert np.abs((estimate - q @ m.T)[spread <= 1e-9]).max(initial=0) < 1e-9
    assert abs(errors.mean()) < 0.05 and errors.std() < 1.1
    assert (np.abs(errors) < vector_search.SURE).mean() > 0.97


def test_hostile(spark):
    good = [[1, 0, 0], [0, 1, 0], [0.5, 0.5, 0], [2, 0, 0], [-1, 0, 0], [1, 0, 0], [1, 0, 0], [-0.0, 1, 0.0]]
    ids = [0, 1, 2, 3, 20, 5, 40, 60]
    nan, inf = float("nan"), float("inf")
    bad = [None, [0, 0, 0], [nan, 1, 0], [1, None, 0], [inf, 0, 0], [1, 2], [], [1, 0, 0]]
    rows = table(spark, ids, good).union(table(spark, [80, 100, 120, 140, 160, 180, 200, None], bad))
    got = found(vector_search.nearest(rows, F.col("vec_id") % 20 == 0, k=3))
    want = brute(ids, good, k=3)
    assert got == want
    assert found(vector_search.nearest(rows, F.col("vec_id") % 20 == 0)) == brute(ids, good)
    again = rows.union(rows).union(table(spark, [0], [[3, 0, 0]]))  # the smaller vector of an id counts
    assert found(vector_search.nearest(again, F.col("vec_id") % 20 == 0, k=3)) == want
    assert found(vector_search.nearest(rows.limit(0), F.col("vec_id") % 20 == 0)) == {}
    assert found(vector_search.nearest(table(spark, [20], [[1, 2]]), F.col("vec_id") % 20 == 0)) == {}


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((200, 8)).tolist() + [[1.0] * 8] * 400
    ids = list(range(600))
    got = found(vector_search.nearest(table(spark, ids, vectors), F.col("vec_id") % 20 == 0))
    check(got, brute(ids, vectors), 0.99)
    assert [j for j, _ in got[400]] == [j for j, _ in brute(ids, vectors)[400]]


@pytest.mark.skipif(not HERE, reason="driver tables are not here")
def test_query_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    query = QUERIES["op12_vector_search"](spark, SF)
    assert query.columns == ["query_id", "rank", "vec_id", "score"]
    check(found(query), want, 0.97)
