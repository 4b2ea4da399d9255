from __future__ import annotations

import random
import re
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from helpers import HERE, SF, documents, hostile

from pageloom.llm import periodic_runs
from pageloom.llm.queries import QUERIES


def brute(words, min_length, min_exponent):
    """Every period at every place, by definition."""
    n, found = len(words), {}
    for p in range(1, n):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            end = i + p
            while end < n and words[end] == words[end - p]:
                end += 1
            if end - i >= max(min_length, min_exponent * p):
                found.setdefault((i, end - i), p)  # periods rise: a stretch keeps its smallest
            i = end - p + 1
    return sorted(((s, k, p) for (s, k), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("length", "exponent"), [(2, 2), (6, 2), (6, 3), (24, 3), (10, 4)])
def test_random_sequences(length, exponent):
    rng = random.Random(length * 10 + exponent)
    for _ in range(400):
        words = rng.choices(range(rng.randint(1, 3)), k=rng.randint(0, 70))
        if rng.random() < 0.6:
            piece = rng.choices(range(3), k=rng.randint(1, 9))
            words += piece * rng.randint(2, 9) + piece[: rng.randint(0, len(piece))] + words[:7] + piece * 4
        got = periodic_runs.runs(np.array(words, dtype=np.int64), length, exponent)
        assert got == brute(words, length, exponent), words


def test_special_words():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    for words in (b, [0] * 900, [0, 1] * 400, [0] * 100 + [1] + [0] * 100 + [1] + [0] * 100):
        assert periodic_runs.runs(np.array(words), 2, 2) == brute(words, 2, 2)
    long = np.arange(100_000) % 1_000
    assert periodic_runs.runs(long) == [(0, 100_000, 1_000)]
    assert periodic_runs.runs(np.zeros(200_000, dtype=np.int64)) == [(0, 200_000, 1)]


def test_documents(spark):
    refrain = "the sun is up and the day is new " * 5 + "end"
    nested = ("x " * 30 + "y ") * 4 + "z"
    docs = hostile(spark).union(documents(spark, [refrain, " a b\x1c " * 30, nested], [20, 21, 22]))
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert periodic_runs.periodic_runs(docs).count() == docs.count()
    assert got[0].n_words == got[1].n_words == got[2].n_words == 0 and got[0].runs == [] and got[0].collapsed_text == ""
    assert [tuple(r) for r in got[5].runs] == [(0, 30_000, 1)] and got[5].collapsed_text == "lang"
    assert [tuple(r) for r in got[20].runs] == [(0, 45, 9)]
    assert got[20].collapsed_text == "the sun is up and the day is new end"
    assert [tuple(r) for r in got[21].runs] == [(0, 30, 1)]
    words = nested.split()
    assert [tuple(r) for r in got[22].runs] == brute(words, 24, 3)
    assert (0, 124, 31) in [tuple(r) for r in got[22].runs]
    assert got[22].collapsed_text == "x y z"
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_strongest(spark):
    rows = [(1, [(0, 30, 10), (5, 90, 30), (9, 31, 10)]), (2, [(0, 30, 10), (40, 60, 20)]), (3, [])]
    df = spark.createDataFrame(rows, "k int, runs array<struct<start:long,length:long,period:long>>")
    got = {r.k: r.b and tuple(r.b) for r in df.select("k", periodic_runs.strongest(df.runs).alias("b")).collect()}
    assert got == {1: (9, 31, 10), 2: (0, 30, 10), 3: None}


@pytest.mark.skipif(not HERE, reason="driver tables are not here")
def test_query(spark):
    """The contract's columns, computed in Python from the contract's words."""

    def digest(text):
        return sha256(text.encode()).hexdigest()

    want = {}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = periodic_runs.runs(np.array([hash(w) % 2**40 for w in words], dtype=np.int64)) if n > 3_000 else brute(words, 24, 3)
        gone = {i for s, k, p in found for i in range(s + p, s + k)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
        want[doc_id] = (
            len(found),
            *best,
            best[0] if best[0] is None else 1000 * best[1] // best[2],
            digest("".join(f"{s},{k},{p}\n" for s, k, p in found)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
        )
    rows = QUERIES["op11_periodic_runs"](spark, SF)
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in rows.collect()} == want
    assert sum(w[0] > 0 for w in want.values()) > 10
