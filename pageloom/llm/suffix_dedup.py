"""Repeated passages: a distributed merge sort of suffixes that never compares a known prefix again.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere. Of all suffixes only those at anchors are
sorted: each window of LENGTH bytes is owned by the GRAM bytes in it with the smallest hash, so equal windows have
their anchors at equal places. An anchor whose hash no other anchor has owns no repeated window and is left out.

The others' suffixes (with the bytes before them, reversed, as second part of the key) are sorted within a task, equal
ones put together, front-coded (only what differs from the one before is kept) and exchanged by anchor. Each receiver
joins its runs with a loser tree that holds, for every run, the prefix length shared with the last string out, and
compares from there on. The prefix lengths that come out of the merge say how far texts agree to the right of an
anchor; inside the intervals of equal prefixes the left parts are compared the same way, and so every window of an
anchor is decided exactly.

A receiver holds the different surroundings of one anchor at a time. An anchor with more than HOT of them (the edge of a
passage that very many texts share) is split: each window it owns becomes a suffix of its own, cut off after LENGTH bytes,
if the window's hash occurs twice. A suffix that a task meets twice is decided there, and only two of its places are sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import hashing
from pageloom.llm.common import whole, written

#: Bytes of a repeated string.
LENGTH = 200
#: Bytes of an anchor. Longer ones are more selective but more of a text's places are anchors: 2 in LENGTH - GRAM + 2.
GRAM = 64
#: Bytes of different suffixes a task holds before it sends them off as a sorted run.
RUN_BYTES = 48 << 20
#: Windows of a text that are looked at together; a longer text is taken in stretches.
STRETCH = 1 << 22
#: Different surroundings of an anchor that are compared in one place; an anchor with more is split.
HOT = 1 << 14
#: Anchors of all texts for each receiver.
PER_RECEIVER = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)
#: Types of a doc_id that is its own number; another one is hashed.
INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: What a task sends: runs of suffixes at anchors, runs of windows, spans that it decided itself.
SUFFIXES, WINDOWS, SPANS = 0, 1, 2
#: Ends the right part of a key; it is no byte of UTF-8.
_END = b"\xff"


def anchors(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of a text: hash, place, and the first and last start of the windows that each owns."""
    for h, place, first, last, _ in _surrounded(data):
        yield h, place, first, last


def _surrounded(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The anchors, and a hash of all bytes in the windows of each."""
    width = LENGTH - GRAM + 1
    for begin in range(0, max(len(data) - LENGTH + 1, 0), STRETCH):
        part = data[begin : begin + STRETCH + LENGTH - 1]
        n = len(part) - GRAM + 1
        sums = hashing.prefix_sums(part)
        grams = hashing.runs(sums, slice(0, n), slice(GRAM, GRAM + n), len(part))
        least, size = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64), 1
        while size * 2 <= width:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        if size < width:
            least = np.minimum(least[: n - width + 1], least[width - size :])
        owner = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last = np.r_[first[1:], len(owner)] - 1
        place = owner[first]
        around = hashing.runs(sums, first, last + LENGTH, len(part))
        yield grams[place].astype(np.int64), place + begin, first + begin, last + begin, around.astype(np.int64)


def windows(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the windows of LENGTH bytes that begin in any of the ranges first to last."""
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    size = last - first + 1
    start = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    part = data[first[0] : last[-1] + LENGTH]
    at = start - first[0]
    return start, hashing.runs(hashing.prefix_sums(part), at, at + LENGTH, len(part)).astype(np.int64)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, id, how often and the surroundings' hash s for the different surroundings of anchors in each text."""
    for batch in batches:
        columns = []
        for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            for h, *_, around in _surrounded(np.frombuffer(text.as_buffer(), dtype=np.uint8)):
                own, at, n = np.unique(around, return_index=True, return_counts=True)
                columns.append((h[at], np.full(len(own), doc), n, own))
        if columns:
            arrays = [pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["h", "id", "n", "s"])


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, id and how often for the different windows that the hot anchors of each text own."""
    for batch in batches:
        for doc, text, hot in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("hot"), strict=True):
            data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
            wanted = hot.values.to_numpy(zero_copy_only=False)
            for h, _, first, last in anchors(data):
                own = np.isin(h, wanted)
                made, n = np.unique(windows(data, first[own], last[own])[1], return_counts=True)
                if len(made):
                    arrays = [pa.array(made), pa.array(np.full(len(made), doc)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["h", "id", "n"])


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted keys: length of the prefix shared with the key before, length of the rest, the rests."""
    shared, rests, before = [], [], b""
    for key in keys:
        n = common(before, key, 0)
        shared.append(n)
        rests.append(key[n:])
        before = key
    return np.array(shared, dtype=np.int32), np.array([len(r) for r in rests], dtype=np.int32), b"".join(rests)


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that are known to agree up to `at`."""
    end = min(len(a), len(b))
    step = 16
    while at < end:
        x, y = a[at : at + step], b[at : at + step]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return at + n - (differ.bit_length() + 7) // 8 if differ else at + n
        at += step
        step = 256
    return end


def _run(found: dict[bytes, list], parts: int) -> Iterator[tuple[int, bytes]]:
    """The suffixes of a task as one front-coded sorted run for each receiver."""
    by_part: dict[int, list[bytes]] = {}
    for key in sorted(found):
        by_part.setdefault(int.from_bytes(hashlib.blake2b(key[:GRAM], digest_size=6).digest(), "big") % parts, []).append(key)
    for part, keys in by_part.items():
        shared, rest, tails = front_coded(keys)
        places = [found[k] for k in keys]
        seen = np.array([len(p) // 3 for p in places], dtype=np.int32)
        where = np.array([x for p in places for x in p], dtype=np.int64).reshape(-1, 3).T
        head = np.array([len(keys), where.shape[1]], dtype=np.int64).tobytes()
        yield part, zstandard.compress(head + shared.tobytes() + rest.tobytes() + seen.tobytes() + where.tobytes() + tails, 3)


class Run:
    """A front-coded run, read key by key."""

    def __init__(self, blob: bytes) -> None:
        data = zstandard.decompress(blob)
        self.n, places = (int(x) for x in np.frombuffer(data, dtype=np.int64, count=2))
        at = 16
        self.shared, self.rest, seen = (
            np.frombuffer(data, dtype=np.int32, count=self.n, offset=at + 4 * self.n * i) for i in range(3)
        )
        at += 12 * self.n
        self.where = np.frombuffer(data, dtype=np.int64, count=3 * places, offset=at).reshape(3, places)
        self.tails, self.tail = data, at + 24 * places
        self.shared, self.rest, self.seen = self.shared.tolist(), self.rest.tolist(), seen.tolist()
        self.i, self.place, self.key = -1, 0, b""
        self.next()

    def next(self) -> int:
        """Goes to the next key; gives the length of the prefix it shares with the one before."""
        if self.i >= 0:
            self.place += self.seen[self.i]
        self.i += 1
        if self.i == self.n:
            self.key = None
            return -1
        n, stop = self.shared[self.i], self.tail + self.rest[self.i]
        self.key = self.key[:n] + self.tails[self.tail : stop]
        self.tail = stop
        return n

    def places(self) -> np.ndarray:
        """node, doc_id and place of the anchors that have the current key."""
        return self.where[:, self.place : self.place + self.seen[self.i]]


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """All keys of the runs in order: length of the prefix shared with the key before, key, places."""
    k = 1
    while k < len(runs):
        k *= 2
    shared = [0] * k
    heads: list[Run | None] = runs + [None] * (k - len(runs))

    def beats(a: int, b: int) -> bool:
        """Whether head a comes before head b; the loser's shared length then refers to the winner."""
        x, y = heads[a], heads[b]
        if x is None or x.key is None:
            return False
        if y is None or y.key is None:
            return True
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        n = common(x.key, y.key, shared[a])
        if n == len(x.key) or (n < len(y.key) and x.key[n] < y.key[n]):
            shared[b] = n
            return True
        shared[a] = n
        return False

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1]
    while heads[top] is not None and heads[top].key is not None:
        head = heads[top]
        yield shared[top], head.key, head.places()
        shared[top] = head.next()
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                top, losers[node] = losers[node], top
            node //= 2


def offsets(keys: list[tuple[bytes, bytes]], shared: list[int]) -> list[list[tuple[int, int]]]:
    """For each of the sorted (right, left) parts around one anchor: how far before it repeated windows start.

    shared[i]: bytes that the right parts i - 1 and i share. Inside an interval that shares r bytes to the right, a
    window that starts o >= LENGTH - r bytes before the anchor occurs twice if two left parts agree in o bytes.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in keys]
    open_ = [(0, len(keys))]
    while open_:
        lo, hi = open_.pop()
        r = min(shared[lo + 1 : hi])
        least = max(LENGTH - r, 0)
        order = sorted(range(lo, hi), key=lambda i: keys[i][1])
        best = dict.fromkeys(order, -1)
        for i, j in zip(order, order[1:], strict=False):
            n = common(keys[i][1], keys[j][1], 0)
            best[i], best[j] = max(best[i], n), max(best[j], n)
        for i, n in best.items():
            if n >= least:
                found[i].append((least, n))
        start = lo
        for i in [*(i for i in range(lo + 1, hi) if shared[i] == r), hi]:
            if i - start > 1:
                open_.append((start, i))
            start = i
    return found


def _decided(group: list[tuple[int, bytes, list]]) -> Iterator[tuple[np.ndarray, int, int]]:
    """Places and offsets (least, most) of the repeated windows around one anchor's occurrences."""
    keys = [tuple(key.split(_END, 1)) for _, key, _ in group]
    several = [sum(p.shape[1] for p in places) > 1 for *_, places in group]
    found: list[list[tuple[int, int]]] = [[] for _ in group]
    if len(group) > 1 and not all(several):
        shared = [0] + [
            min(n, len(keys[i - 1][0]), len(keys[i][0])) for i, (n, *_) in enumerate(group) if i
        ]
        found = offsets(keys, shared)
    for (right, left), twice, own, (*_, places) in zip(keys, several, found, group, strict=True):
        for least, most in [(LENGTH - len(right), len(left))] if twice else own:
            for p in places:
                yield p, least, most


def _merge(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
    """Repeated bytes as node, id, start, stop, of the runs of one receiver.

    kind says what a blob holds: a run of suffixes at anchors, a run of windows, or spans decided in the task that sent it.
    """
    kind = blobs["kind"]
    spans = [np.frombuffer(zstandard.decompress(b), dtype=np.int64).reshape(4, -1) for b in blobs["blob"][kind == SPANS]]
    out: list[np.ndarray] = spans

    def close(group: list) -> None:
        if len(group) > 1 or (group and sum(p.shape[1] for p in group[0][2]) > 1):
            for places, least, most in _decided(group):
                node, doc, at = places
                out.append(np.stack([node, doc, at - most, at - least + LENGTH]))

    for of, anchor in ((SUFFIXES, GRAM), (WINDOWS, LENGTH)):
        group: list[tuple[int, bytes, list]] = []
        for shared, suffix, places in merged([Run(b) for b in blobs["blob"][kind == of]]):
            if group and shared == len(suffix) == len(group[-1][1]):
                group[-1][2].append(places)
                continue
            if group and shared < anchor:
                close(group)
                group = []
            group.append((shared, suffix, [places]))
        close(group)
    cells = np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)
    return pd.DataFrame(dict(zip(("node", "id", "start", "stop"), cells, strict=True)))


def covered(spans: list, n: int) -> np.ndarray:
    """Maximal runs [start, stop) of the bytes in any of the spans."""
    if not len(spans):
        return np.zeros((0, 2), dtype=np.int64)
    cells = np.asarray(spans, dtype=np.int64).reshape(-1, 2)
    cells = cells[np.argsort(cells[:, 0], kind="stable")]
    reach = np.maximum.accumulate(cells[:, 1])
    new = np.r_[True, cells[1:, 0] > reach[:-1]]
    return np.stack([cells[new, 0], reach[np.r_[np.flatnonzero(new)[1:], len(cells)] - 1]], axis=1)


def _settled(found: dict[bytes, list]) -> np.ndarray:
    """Spans of the suffixes met several times, whose windows are all repeated; two places of each are left in `found`."""
    out = []
    for key, places in found.items():
        if len(places) > 6:
            right = key.index(_END)
            node, doc, at = np.array(places, dtype=np.int64).reshape(-1, 3).T
            out.append(np.stack([node, doc, at - (len(key) - right - 1), at - (LENGTH - right) + LENGTH]))
            del places[6:]
    return np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)


def _sent(parts: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[bytes, list]] = {SUFFIXES: {}, WINDOWS: {}}
        held = 0

        def add(kind: int, key: bytes, *place: int) -> None:
            nonlocal held
            places = found[kind].get(key)
            if places is None:
                found[kind][key] = places = []
                held += len(key) + 150
            places += place
            held += 100

        def row(kind: int, part: int, blob: bytes) -> pa.RecordBatch:
            cells = [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names=["part", "kind", "blob"])

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for kind, keys in found.items():
                spans = _settled(keys)
                if spans.shape[1]:
                    yield row(SPANS, int(spans[0, 0] % parts), zstandard.compress(spans.tobytes(), 3))
                for part, blob in _run(keys, parts):
                    yield row(kind, part, blob)
                keys.clear()
            held = 0

        for batch in batches:
            lists = [batch.column(c) for c in ("hashes", "hot", "repeated")]
            for i, (node, doc, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("node", "id", "text")], strict=True)):
                wanted, hot, repeated = (c[i].values.to_numpy(zero_copy_only=False) for c in lists)
                data = np.frombuffer(text, dtype=np.uint8)
                for h, place, lo, hi in anchors(data):
                    own = np.isin(h, wanted)
                    for at, first, last in zip(place[own].tolist(), lo[own].tolist(), hi[own].tolist(), strict=True):
                        add(SUFFIXES, text[at : last + LENGTH] + _END + text[first:at][::-1], node, doc, at)
                    if len(hot):
                        own = np.isin(h, hot)
                        start, made = windows(data, lo[own], hi[own])
                        for at in start[np.isin(made, repeated)].tolist():
                            add(WINDOWS, text[at : at + LENGTH] + _END, node, doc, at)
                    if held > RUN_BYTES:
                        yield from packed()
        if held:
            yield from packed()

    return send


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch, rows = batch[batch["lone"]], []
        for text, starts, stops in zip(batch["text"], batch["starts"], batch["stops"], strict=True):
            spans = covered([] if starts is None else np.stack([starts, stops], axis=1), len(text))
            kept, at = hashlib.sha256(), 0
            view = memoryview(text)
            for start, stop in spans.tolist():
                kept.update(view[at:start])
                at = stop
            kept.update(view[at:])
            removed = int((spans[:, 1] - spans[:, 0]).sum())
            rows.append((len(text), removed, len(spans), kept.hexdigest(), spans[:, 0].tolist(), spans[:, 1].tolist()))
        made = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops"])
        yield pd.concat([batch[["doc_id"]].reset_index(drop=True), made], axis=1)


def _wanted(compared: DataFrame, found: DataFrame, twice: DataFrame) -> DataFrame:
    """What each text sends: id, hashes (of anchors that occur twice), hot (of anchors to split), repeated (of the
    windows of those that occur twice)."""
    none = F.array().cast("array<long>")
    busy = twice.where(F.col("n") > HOT).select("h")
    each = found.join(busy, "h").groupBy("h", "s").agg(F.lit(1).alias("one"))
    hot = written(each.groupBy("h").agg(F.sum("one").alias("n")).where(F.col("n") > HOT).select("h"), "hot")
    listed = lambda rows, name: rows.groupBy("id").agg(F.collect_set("h").alias(name))
    if hot.isEmpty():
        return listed(found.join(twice.select("h"), "h"), "hashes").select("id", "hashes", none.alias("hot"), none.alias("repeated"))
    cold = listed(found.join(twice.select("h"), "h").join(hot, "h", "left_anti"), "hashes")
    owners = written(listed(found.join(hot, "h"), "hot"), "owners")
    split = compared.join(owners, "id").select("id", "text", "hot").mapInArrow(_window_hashes, "h long, id long, n long")
    split = written(split, "windows")
    again = written(split.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "again")
    rows = cold.join(owners, "id", "full").join(listed(split.join(again, "h"), "repeated"), "id", "full")
    return rows.select("id", *[F.coalesce(c, none).alias(c) for c in ("hashes", "hot", "repeated")])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, stops (of the removed runs).

    Texts count as UTF-8 bytes; matches never cross documents. Null and empty texts, and those shorter than LENGTH,
    lose nothing. Rows of one doc_id with one text repeat each other, so they lose all of it, however many they are;
    one of them stands for all where other texts are compared. Overlapping occurrences count, and all is judged on the
    input. Null doc_ids are ids like any other, a doc_id may be of any type; an empty table gives an empty table; other
    columns are ignored.
    """
    spark = docs.sparkSession
    node = F.xxhash64(F.col(doc_id), whole(text))
    # Rows without a doc_id are spread by what they hold.
    number = F.xxhash64(doc_id) if docs.schema[doc_id].dataType.simpleString() not in INTEGERS else F.col(doc_id).cast("long")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.when(F.col(doc_id).isNotNull(), number), node).alias("id"),
        node.alias("node"),
        whole(text).cast("binary").alias("text"),
    )
    key = ["id", "node"]
    long = rows.where(F.length("text") >= LENGTH)
    copied = written(long.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "copied")
    copies = long.join(copied, key, "left_semi")
    compared = long.join(copied, key, "left_anti").withColumn("lone", F.lit(True)).unionByName(
        copies.dropDuplicates(key).withColumn("lone", F.lit(False))
    )
    found = written(compared.select("id", "text").mapInArrow(_hashes, "h long, id long, n long, s long"), "anchors")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), found.count() // PER_RECEIVER)
    # Written, so that the join deals out both sides and can split a frequent hash.
    twice = written(found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "twice")
    wanted = _wanted(compared, found, twice)
    # One exchange of the texts serves both joins: they have the same key and take the same columns.
    dealt = compared.repartition(parts, "id")
    runs = (
        dealt.join(wanted, "id")
        .select("doc_id", "node", "id", "text", "lone", "hashes", "hot", "repeated")
        .mapInArrow(_sent(parts), "part int, kind int, blob binary")
    )
    spans = runs.groupBy("part").applyInPandas(_merge, "node long, id long, start long, stop long")
    of_text = spans.groupBy("id").agg(F.collect_list(F.struct("node", "start", "stop")).alias("spans"))
    # What stands for copies is left out at the end: a filter here would move below the exchange and make it two.
    joined = dealt.join(of_text, "id", "left").select(
        "doc_id", "text", "lone", F.filter("spans", lambda s: s["node"] == F.col("node")).alias("spans")
    )
    schema = (
        f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, "
        "kept_sha256 string, starts array<long>, stops array<long>"
    )
    none = F.lit(None).cast("array<long>")
    whole_text = [F.array(F.lit(0).cast("long")), F.array(F.length("text").cast("long"))]
    names = ("doc_id", "text", "lone", "starts", "stops")
    of_each = [
        joined.select("doc_id", "text", "lone", "spans.start", "spans.stop").toDF(*names),
        copies.select("doc_id", "text", F.lit(True), *whole_text).toDF(*names),
        rows.where(F.length("text") < LENGTH).select("doc_id", "text", F.lit(True), none, none).toDF(*names),
    ]
    return reduce(DataFrame.unionByName, of_each).mapInPandas(_cut, schema)


def brute(texts: list[bytes]) -> list[np.ndarray]:
    """The removed runs of each text, by counting all windows; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - LENGTH + 1):
            seen[t[i : i + LENGTH]] = seen.get(t[i : i + LENGTH], 0) + 1
    return [
        covered([(i, i + LENGTH) for i in range(len(t) - LENGTH + 1) if seen[t[i : i + LENGTH]] > 1], len(t)) for t in texts
    ]
