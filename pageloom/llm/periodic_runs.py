"""Stretches of a text that repeat themselves with a fixed period, and texts with the repeats taken out.

Two suffixes that agree on L words from the places i < j = i + p give the stretch from i to j + L the period p. Places
that agree on at least L words form a class; the classes grow as L falls. So the suffixes' neighbours are taken by
falling common prefix, as Kruskal's method takes edges, and a union-find joins their classes, each with its places in
order. When a union makes two places neighbours, at the distance p <= L, a run with the smallest period p goes on until
j + L: had it a smaller period, a place between them would have been in the class before. The run starts at i unless
the words before i and j agree too; then the pair one to the left stands for the same run.

A run of at least MIN_LENGTH words and MIN_EXPONENT periods needs an L of some words (16 for 24 and 3). Places whose
next words of that number occur nowhere else in the text take no part, and most texts have no others.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import whole

#: A run has at least so many words, and so many times its period.
MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Words are what stands between the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: A class of at most so many places is put into a larger one place by place, a larger one by sorting the two together.
FEW = 8


def _repeated(words: np.ndarray, width: int) -> np.ndarray:
    """Places whose next `width` words have the hash of those at another place; equal words have equal hashes."""
    n = len(words) - width + 1
    if n < 2:
        return np.empty(0, np.int64)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * FACTOR
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, np.uint64)
    for k in range(width):
        hashes *= FACTOR
        hashes += mixed[k : k + n]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    return np.sort(order[np.r_[False, same] | np.r_[same, False]])


def _ranks(words: np.ndarray) -> list[np.ndarray]:
    """For each k the rank of the next 2**k words of every place among all places; what ends earlier ranks first.

    Ranks are from 1; place n, after the end, has rank 0. The last ranks all differ.
    """
    n = len(words)
    level = np.zeros(n + 1, np.int32)
    level[:n] = np.unique(words, return_inverse=True)[1] + 1
    levels, step = [level], 1
    while level.max() < n:
        key = level[:n].astype(np.int64) * (n + 1)
        key[: n - step] += level[step:n]
        level = np.zeros(n + 1, np.int32)
        level[:n] = np.unique(key, return_inverse=True)[1] + 1
        levels.append(level)
        step *= 2
    return levels


def _agreement(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of words on which the suffixes at `left` and at `right` agree, pair by pair."""
    n = len(levels[0]) - 1
    at, other = left.copy(), right.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(at, other) + (1 << k) <= n
        step = (inside & (levels[k][np.minimum(at, n)] == levels[k][np.minimum(other, n)])) * (1 << k)
        at += step
        other += step
    return at - left


def _joined(mine: list[int], theirs: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Two classes' places together, in order, and the pairs that are neighbours only now."""
    large, small = (mine, theirs) if len(mine) >= len(theirs) else (theirs, mine)
    pairs, last = [], len(small) - 1
    for k, x in enumerate(small):
        at = bisect_left(large, x)
        if at and (not k or small[k - 1] < large[at - 1]):
            pairs.append((large[at - 1], x))
        if at < len(large) and (k == last or small[k + 1] > large[at]):
            pairs.append((x, large[at]))
    if len(small) <= FEW:
        for x in small:
            large.insert(bisect_left(large, x), x)
    else:
        large += small
        large.sort()
    return large, pairs


def runs(words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period.

    A run's period is its smallest, and no neighbouring word extends it with that period. min_exponent is 2 or more.
    """
    need = max(1, -(-min_length * (min_exponent - 1) // min_exponent))
    places = _repeated(words, need)
    if not len(places):
        return []
    levels = _ranks(words)
    order = places[np.argsort(levels[-1][places])]
    agree = _agreement(levels, order[:-1], order[1:])
    edges = np.flatnonzero(agree >= need)
    edges = edges[np.argsort(-agree[edges], kind="stable")]
    order, word = order.tolist(), words.tolist()
    parent = list(range(len(order)))
    classes: list[list[int] | None] = [[x] for x in order]

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    found = []
    for k, common in zip(edges.tolist(), agree[edges].tolist(), strict=True):
        a, b = root(k), root(k + 1)
        if len(classes[a]) < len(classes[b]):
            a, b = b, a
        parent[b] = a
        classes[a], pairs = _joined(classes[a], classes[b])
        classes[b] = None
        for i, j in pairs:
            period = j - i
            length = period + common
            if length >= min_length and length >= min_exponent * period and (not i or word[i - 1] != word[j - 1]):
                found.append((i, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: a run's first period does, what repeats it goes."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def periodic_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: Column | str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period in words, by start, then period) and
    collapsed_text: the words that no run repeats, joined by one space.

    Every text is read whole, in its own row, without a shuffle; a task holds one batch of texts and about 100 bytes a
    word of the text at hand. Null, empty and blank texts have no words, no runs and an empty collapsed text. Of equally
    good readings of a stretch the smallest period counts; overlapping runs are all given. Repeated rows and null
    doc_ids give rows like any other, an empty table gives none, other columns are ignored.
    """
    split = re.compile(WORD).findall

    def read(value: str) -> tuple[int, list[tuple[int, int, int]], str]:
        words = split(value)
        if len(words) < min_length:
            return len(words), [], " ".join(words)
        seen: dict[str, int] = {}
        numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        found = runs(numbers, min_length, min_exponent)
        if not found:
            return len(words), [], " ".join(words)
        kept = collapsed(len(words), found)
        return len(words), found, " ".join([w for w, stays in zip(words, kept.tolist(), strict=True) if stays])

    row = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(value) for value in batch.column(1).to_pylist()]
            listed = [[{"start": s, "length": k, "period": p} for s, k, p in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(listed, pa.list_(row)),
                    pa.array([r[2] for r in rows], pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed_text"],
            )

    given = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    runs_kind = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
    return given.mapInArrow(found_in, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, {runs_kind}")


def strongest(found: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first. Null without runs."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(found, F.get(found, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))
