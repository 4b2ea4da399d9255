"""A quality classifier on learned subword embeddings.

Words, word pairs and character n-grams of a text are hashed to buckets; each bucket has a learned vector. A document
is the average of its vectors, and a softmax layer turns it into class probabilities. Vectors and layer are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm import hashing
from pageloom.llm.common import whole, written

BUCKETS = 1 << 17
DIM = 10
GRAMS = (3, 4)
EPOCHS = 8
#: Steps made at least: small samples go through more epochs.
STEPS = 12_000
RATE = 0.5
#: Labelled rows that are trained on at most: those with the smallest hashes of their ids.
SAMPLE = 3000
#: Bytes whose features are made at once, unless a single text is longer.
AT_ONCE = 1 << 19


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and for each the place of its text."""
    parts = [b" " + t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    white = data <= 32
    wide = data.astype(np.uint64)
    found, places = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        last = len(data) - n + 1
        key, inside = wide[:last].copy(), np.ones(last, dtype=bool)
        for i in range(1, n):
            key = (key << np.uint64(8)) | wide[i : last + i]
            if i < n - 1:
                inside &= ~white[i : last + i]
        at = np.flatnonzero(inside)
        found.append(hashing.mixed(key[at] + np.uint64(n << 56)))
        places.append(at)
    start = np.flatnonzero(~white & np.r_[True, white[:-1]])
    stop = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    sums = hashing.prefix_sums(data)
    word = hashing.runs(sums, start, stop, len(data))
    found.append(word)
    places.append(start)
    if len(word) > 1:
        same = np.searchsorted(ends, start[:-1], "right") == np.searchsorted(ends, start[1:], "right")
        found.append(hashing.mixed(word[:-1] * np.uint64(3) + word[1:])[same])
        places.append(start[:-1][same])
        # A pair of equal words is also one n-gram whatever the word, so that stuttering is learned as such.
        twice = same & (word[:-1] == word[1:])
        found.append(np.full(twice.sum(), 1 << 63, dtype=np.uint64))
        places.append(start[:-1][twice])
    buckets = (np.concatenate(found) >> np.uint64(40)).astype(np.int64) % BUCKETS
    return buckets, np.searchsorted(ends, np.concatenate(places), "right")


def portions(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of about AT_ONCE characters; a longer text stands alone."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Buckets and their counts of each text, as bytes of int32."""
    for batch in batches:
        out = []
        for text in batch:
            bucket, n = np.unique(features([text])[0], return_counts=True)
            out.append((bucket.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()))
        yield pd.DataFrame(out, columns=["bucket", "n"])


class Model:
    """Vectors of the buckets and the softmax layer."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        layer = np.zeros((DIM, 2), dtype=np.float32)
        share = float(np.mean([y for *_, y in rows])) if rows else 0.5
        share = min(max(share, 0.01), 0.99)
        bias = np.log(np.array([1 - share, share], dtype=np.float32))
        both = 0 < sum(y for *_, y in rows) < len(rows)
        epochs = max(EPOCHS, -(-STEPS // max(len(rows), 1))) if both else 0
        for epoch in range(epochs):
            for step, i in enumerate(random.permutation(len(rows))):
                bucket, n, y = rows[i]
                if not len(bucket):
                    continue
                rate = np.float32(RATE * (1 - (epoch + step / len(rows)) / epochs))
                weight = (n / n.sum()).astype(np.float32)
                mean = weight @ vectors[bucket]
                logit = mean @ layer + bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[y] -= 1
                back = layer @ p
                layer -= rate * np.outer(mean, p)
                bias -= np.float32(0.1) * rate * p
                # Steps of the vectors are scaled by the number of features, as if each had its own turn.
                vectors[bucket] -= rate * np.minimum(n, 8)[:, None].astype(np.float32) * back / len(bucket) * 16
        # Averaging and the layer are linear: one number for each bucket gives the same log-odds.
        self.odds = (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64)
        self.bias = float(bias[1] - bias[0])

    def score(self, texts: list[str]) -> np.ndarray:
        bucket, place = features(texts)
        size = np.bincount(place, minlength=len(texts))
        total = np.bincount(place, weights=self.odds[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(size, 1) + self.bias)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, sample: int) -> DataFrame:
    """At most `sample` labelled rows that may be learned from: text, y. Of several labels of an id the largest counts."""
    ids = (
        labels.select(F.col("doc_id").alias("labelled"), F.col(label).alias("y"))
        .where("labelled is not null and y is not null")
        .groupBy("labelled")
        .agg(F.max("y").cast("int").alias("y"))
        .where(train)
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(sample)
    )
    rows = docs.select("doc_id", whole("text").alias("text"))
    return written(rows.join(F.broadcast(ids), rows.doc_id == ids.labelled).select("labelled", "text", "y"), "labelled")


def trained(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", sample: int = SAMPLE) -> Model:
    """train: condition on the column `labelled` (a doc_id) that says which labels may be learned."""
    count = F.pandas_udf(_counted, "bucket binary, n binary")
    # Rows of one id (repeated rows) are few; the sample bounds what comes to the driver.
    found = labelled(docs, labels, label, train, sample).dropDuplicates(["labelled"])
    rows = found.orderBy("labelled").select("y", count("text").alias("f")).select("y", "f.*").toPandas()
    return Model(
        [
            (np.frombuffer(b, dtype=np.int32), np.frombuffer(n, dtype=np.int32), int(y))
            for y, b, n in zip(rows.y, rows.bucket, rows.n, strict=True)
        ]
    )


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score (probability of label 1).

    Only the text is read. Null and empty texts have no features and score by the learned bias; a table without
    labels gives 0.5 everywhere, one class only the share of that class, held within 0.01 and 0.99. Repeated rows
    score equally; an empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [held.value.score(part) for part in portions(batch)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return docs.select(F.col(doc_id).alias("doc_id"), score(whole(text)).alias("score"))
