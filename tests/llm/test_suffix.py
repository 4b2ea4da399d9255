from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest
from helpers import HERE, SF, documents, hostile
from pyspark.sql import functions as F

from pageloom.llm import suffix_dedup as sd


def check(spark, docs):
    data = docs.select("doc_id", "text").collect()
    texts = [(r.text or "").encode() for r in data]
    want = []
    for r, t, spans in zip(data, texts, sd.brute(texts), strict=True):
        kept, at = b"", 0
        for a, z in spans.tolist():
            kept, at = kept + t[at:a], z
        kept += t[at:]
        want.append((r.doc_id, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), t))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted((tuple(r) for r in sd.repeated_spans(docs).select(*columns).collect()), key=repr)
    assert got == sorted((w[:5] for w in want), key=repr)


def mosaic(n):
    random.seed(n)
    base = ["".join(random.choice("ab é") for _ in range(600)) for _ in range(4)]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(random.randint(0, 5)):
            at = random.randint(0, 500)
            t += random.choice(base)[at : at + random.randint(1, 300)]
            t += random.choice(["", "", "x", "wher. " * random.randint(1, 120)])
        out.append(t)
    return out


def test_hostile(spark):
    check(spark, hostile(spark).where("length(text) < 100000 or text is null"))


def test_mosaics(spark):
    check(spark, documents(spark, mosaic(80)).repartition(5))


def test_many_runs_and_stretches(spark, monkeypatch):
    # Within the driver: the same work in small runs and stretches.
    texts = [t.encode() for t in mosaic(40)]
    monkeypatch.setattr(sd, "STRETCH", 37)
    whole = {}
    for i, t in enumerate(texts):
        for h, place, lo, hi in sd.anchors(np.frombuffer(t, dtype=np.uint8)):
            for a, b, c in zip(place.tolist(), lo.tolist(), hi.tolist(), strict=True):
                whole.setdefault(t[a : c + sd.LENGTH] + b"\xff" + t[b:a][::-1], []).extend((i, i, a))
    keys = sorted(whole)
    blobs = [b for k in range(7) for _, b in sd._run({x: whole[x] for x in keys[k::7]}, 1)]
    import pandas as pd

    found = sd._merge((0,), pd.DataFrame({"blob": blobs, "kind": sd.SUFFIXES}))
    for i, want in enumerate(sd.brute(texts)):
        own = found[found.node == i][["start", "stop"]].to_numpy()
        assert sd.covered(list(own), len(texts[i])).tolist() == want.tolist()


def test_merge_is_sorted_and_prefixes_are_true():
    random.seed(2)
    keys = sorted({bytes(random.choice(b"ab") for _ in range(random.randint(1, 30))) for _ in range(400)})
    runs = []
    for k in range(5):
        own = {x: [0, 0, i] for i, x in enumerate(keys) if random.random() < 0.5 or i % 5 == k}
        runs += [sd.Run(b) for _, b in sd._run(own, 1)]
    before, seen = b"", []
    for n, key, _ in sd.merged(runs):
        assert n == sd.common(before, key, 0)
        seen.append(key)
        before = key
    assert seen == sorted(seen) and set(seen) == set(keys)


@pytest.mark.skipif(not HERE, reason="driver tables are not here")
def test_driver_table(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_long_and_empty(spark):
    long = "lang " * 60_000
    out = sd.repeated_spans(documents(spark, [long, "b" * 199, None])).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans) for r in out] == [(300_000, 1), (0, 0), (0, 0)]
    assert sd.repeated_spans(documents(spark, ["a"]).limit(0)).count() == 0


def test_many_equal_rows(spark):
    """Equal rows of one id, as many without an id, a text that shares a passage with them, and ids that are no numbers."""
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    text, other = (" ".join(word() for _ in range(350)) for _ in range(2))
    many = 20_000
    start = time.monotonic()
    equal = spark.range(many).select(F.lit(4).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    lone = spark.range(many).select(F.lit(None).cast("long").alias("doc_id"), F.lit(other).alias("text"))
    shares = spark.createDataFrame([(9, "x" * 40 + text[300:700] + "y" * 300)], "doc_id bigint, text string")
    out = sd.repeated_spans(equal.union(lone).union(shares).repartition(16))
    got = {tuple(r)[:3]: r["n"] for r in out.groupBy("doc_id", "n_removed", "n_spans").agg(F.count("*").alias("n")).collect()}
    # y * 300 repeats itself: all but no byte of it is covered by a string that starts twice.
    assert got == {(4, len(text), 1): many, (None, len(other), 1): many, (9, 400 + 300, 1): 1}
    assert time.monotonic() - start < 60
    check(spark, equal.limit(5).union(lone.limit(4)).union(shares).union(equal.limit(3).withColumn("text", F.lit("short"))))
    named = documents(spark, [text, text, other]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert sorted((r.doc_id, r.n_removed) for r in sd.repeated_spans(named).collect()) == [("d0", len(text)), ("d1", len(text)), ("d2", 0)]


def test_hot_anchors_are_split(spark, monkeypatch):
    """A passage in a third of the texts, its surroundings different everywhere, with few surroundings to a receiver."""
    random.seed(5)
    letters = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage, edge = letters(700), letters(90)
    texts = [letters(random.randint(0, 300)) + (passage if i % 3 == 0 else "") + letters(random.randint(0, 300)) for i in range(300)]
    # Windows that reach over the edge, some of them twice.
    texts += [letters(50) + edge + passage[:150] + letters(99) for _ in range(20)] + [edge[-40:] + passage[:170]] * 2
    docs = documents(spark, texts).repartition(6)
    monkeypatch.setattr(sd, "HOT", 8)
    seen = []
    held = sd.written
    monkeypatch.setattr(sd, "written", lambda df, name: seen.append((name, out := held(df, name))) or out)
    check(spark, docs)
    tables = dict(seen)
    assert tables["hot"].count() > 1 and tables["again"].count() > 100
    check(spark, documents(spark, mosaic(60)).repartition(5))
