"""Near duplicates by ProbMinHash over word shingles.

Every shingle of a text sends arrivals of a Poisson process whose rate is its weight, each to a random register; a
register keeps the shingle that arrives first. Arrivals of a shingle end as soon as they come later than every
register's time. Two texts agree in a register with the probability Jaccard similarity of their weighted shingles.
Registers are joined to bands; texts that share a band may be similar, and the Jaccard similarity of their shingle sets
decides. Equal texts are one class from the start, so copies cost nothing further. A bucket is not expanded into pairs:
stars link most of it, and what they leave apart meets by a prefix filter, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.rows import exploded
from pageloom.llm import hashing
from pageloom.llm.common import whole, written
from pageloom.llm.components import components
from pageloom.llm.quality import portions

#: Words of a shingle; a shorter text is one shingle.
WORDS = 5
#: Similarity from which texts are linked.
SIMILAR = 0.8
#: Registers, a power of two; bands of ROWS registers. At similarity 0.8 a pair shares a band with probability 0.99995 if
#: what differs weighs like the rest, and 0.997 if all that differs has the greatest weight and the rest the least.
REGISTERS, BANDS, ROWS = 128, 25, 5
#: Rounds of stars before pairs are formed.
STARS = 2
_STEP = np.uint64(0xD1B54A32D192ED03)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: place of the text, hash, letters. Sorted by place and hash."""
    parts = [b" " + t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    white = data <= 32
    start = np.flatnonzero(~white & np.r_[True, white[:-1]])
    stop = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    word = hashing.runs(hashing.prefix_sums(data), start, stop, len(data))
    owner = np.searchsorted(ends, start, "right")
    size = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(size) - size
    # A text of fewer words than a shingle has one that begins at its first word and takes what there is.
    begins = np.ones(len(word), dtype=bool)
    place = np.arange(len(word))
    begins &= (place + WORDS <= (first + size)[owner]) | ((place == first[owner]) & (size[owner] < WORDS))
    at = place[begins]
    made = word[at]
    size_of = stop - start
    letters = size_of[at]
    for k in range(1, WORDS):
        then = np.minimum(at + k, len(word) - 1)
        inside = at + k < (first + size)[owner[at]]
        made = np.where(inside, hashing.mixed(made * _STEP + word[then]), made)
        letters = letters + np.where(inside, size_of[then], 0)
    own = owner[at]
    order = np.lexsort((made, own))
    made, own, letters = made[order], own[order], letters[order]
    new = np.r_[True, (made[1:] != made[:-1]) | (own[1:] != own[:-1])] if len(made) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return own[begin], made[begin], letters[begin]


def weights(letters: np.ndarray) -> np.ndarray:
    """Weight of a shingle, 1 to 1.5: long words say more than short ones, which many texts share. It depends on nothing
    but the shingle: a weight that grew with the count would differ between two texts that repeat shingles differently,
    and keep similar ones from meeting."""
    return 1 + np.minimum(letters, 64) / 128


def registers(place: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The first shingle of each register of n texts; 0 everywhere for texts without shingles."""
    times = np.full(n * REGISTERS, np.inf)
    first = np.zeros(n * REGISTERS, dtype=np.uint64)
    now = np.zeros(len(element))
    round_ = 0
    while len(element):
        round_ += 1
        drawn = hashing.mixed(element + _STEP * np.full(1, round_, dtype=np.uint64))
        uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        now = now - np.log(uniform) / weight
        at = place * REGISTERS + (drawn & np.uint64(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(times, at, now)
        won = times[at] == now
        first[at[won]] = element[won]
        latest = times.reshape(n, REGISTERS).max(axis=1)
        live = now < latest[place]
        place, element, weight, now = place[live], element[live], weight[live], now[live]
    return first.reshape(n, REGISTERS)


def bands(first: np.ndarray) -> np.ndarray:
    """One hash for each band of each text."""
    made = np.zeros((len(first), BANDS), dtype=np.uint64)
    for row in range(ROWS):
        made = hashing.mixed(made * _STEP + first[:, row * BANDS : (row + 1) * BANDS])
    return hashing.mixed(made + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)


@F.pandas_udf(T.StructType().add("n", "integer").add("bands", T.ArrayType(T.LongType())))
def _signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n, out = [], []
        for part in portions(batch):
            place, made, letters = shingles(part)
            n.extend(np.bincount(place, minlength=len(part)).tolist())
            out.extend(bands(registers(place, made, weights(letters), len(part))))
        yield pd.DataFrame({"n": pd.Series(n, dtype="int32"), "bands": pd.Series(out, dtype=object)})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([shingles([text])[1].astype(np.int64) for text in batch], dtype=object)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of distinct shingles; texts without shingles are similar to none."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if common else 0.0


@F.pandas_udf(T.DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _words(text: Column | str) -> Column:
    """Text in small letters, words apart by one space: equal forms have equal shingles."""
    return F.trim(F.regexp_replace(F.lower(whole(text)), r"[\x00-\x20]+", " "))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b that are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("h").alias("h1"))
    right = sets.select(F.col("node").alias("b"), F.col("h").alias("h2"))
    rows = pairs.join(left, "a").join(right, "b")
    return written(rows.where(_jaccard("h1", "h2") >= SIMILAR).select("a", "b"), "linked")


def _alike(n1: Column, n2: Column) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(n1, n2) >= SIMILAR * F.greatest(n1, n2)


def _mixed(buckets: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components."""
    spread = buckets.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return buckets.join(spread.select("k"), "k", "left_semi")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components that can be similar, none left out: a, b. nodes: node, n, comp.

    With shingles ordered by rarity, two similar sets share one among the first n - SIMILAR * n + 1 of the larger and
    the first n - 2 * SIMILAR / (1 + SIMILAR) * n + 1 of the smaller. What many texts share comes last in that order,
    so texts that have but a common passage, or are copies changed too much, do not meet.
    """
    rows = exploded(nodes.join(sets, "node"), "h", "node", "n", "comp").select("node", "n", "comp", F.col("e").alias("h"))
    shared = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    common = written(rows.join(shared, "h"), "common")
    alone = common.groupBy("node").agg(F.count("*").alias("met"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "h"))
    ranked = common.withColumn("rank", rank).join(alone, "node").withColumn("rank", F.col("n") - F.col("met") + F.col("rank"))
    # Rounding must not shorten a prefix, hence the small part taken off before it is rounded up.
    longer = F.col("n") - F.ceil(F.lit(SIMILAR) * F.col("n") - 1e-9) + 1
    shorter = F.col("n") - F.ceil(F.lit(2 * SIMILAR / (1 + SIMILAR)) * F.col("n") - 1e-9) + 1
    first = written(ranked.where(F.col("rank") <= longer).withColumn("both", F.col("rank") <= shorter).drop("df", "met"), "prefix")
    columns = ("node", "n", "comp", "both", "rank")
    own, other = (first.select("h", *[F.col(c).alias(f"{c}{i}") for c in columns]) for i in (1, 2))
    apart = (F.col("comp1") != F.col("comp2")) & _alike(F.col("n1"), F.col("n2")) & F.col("both2")
    order = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") > F.col("node2")))
    # At the first shingle that two sets share, so much of each can still be common at most.
    rest = F.least(F.col("n1") - F.col("rank1"), F.col("n2") - F.col("rank2")) + 1
    enough = rest >= F.lit(SIMILAR / (1 + SIMILAR)) * (F.col("n1") + F.col("n2")) - 1e-9
    met = own.join(other, "h").where(apart & order & enough)
    return met.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per document doc_id, digest (of its words), class_id, class_size, kept; and the links between text classes.

    Documents are linked at similarity SIMILAR or more over shingles of WORDS words (split at white space, small
    letters); a class is a connected component. class_id is its smallest doc_id, whose row stays (null doc_ids come
    last; of repeated rows one stays). Documents without words (null, empty or blank texts) have no shingles and are
    each a class of their own. An empty table gives an empty table; other columns are ignored.
    """
    normal = docs.select(
        F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), _words(text).alias("text")
    )
    signed = written(
        normal.select("doc_id", "row", F.sha2("text", 256).alias("digest"), _signed("text").alias("s")).select(
            "doc_id", "row", F.unhex("digest").alias("digest"), "s.n", "s.bands"
        ),
        "signed",
    )
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")
    # One node for each different text; its id is the row that comes first.
    texts = written(
        signed.where("n > 0")
        .groupBy("digest")
        .agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
        .select("digest", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("node"), "n", "bands", "copies"),
        "texts",
    )
    each = texts.select("node", "n", F.posexplode("bands").alias("band", "hash")).select(
        "node", "n", F.struct("band", "hash").alias("k")
    )
    sizes = each.groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
    buckets = written(each.join(sizes, "k").select("k", "node", "n", "size"), "buckets")
    # The text that meets the most others is likely the one the others are copies of.
    scores = buckets.groupBy("node").agg(F.sum("size").alias("score"))
    buckets = written(buckets.drop("size").join(scores, "node"), "scored")
    needed = texts.join(buckets.select("node").distinct(), "node").select("node", "doc_id", "digest")
    rows = docs.select(F.col(doc_id).alias("id"), _words(text).alias("text"))
    same = F.col("id").eqNullSafe(F.col("doc_id"))
    found = rows.join(needed, same).where(F.unhex(F.sha2("text", 256)) == F.col("digest"))
    sets = written(
        found.select("node", _set("text").alias("h")).groupBy("node").agg(F.first("h").alias("h")),
        "sets",
    )
    # Stars: the most met text of each bucket with all others of the bucket, then the most met one that is not linked
    # to it with all that are not linked to that one.
    links, comps = None, None
    for _ in range(STARS):
        joined = buckets if comps is None else buckets.join(comps, "node", "left")
        joined = joined.withColumn("comp", F.col("node") if comps is None else F.coalesce("comp", "node"))
        mixed = _mixed(joined)
        center = mixed.groupBy("k").agg(F.max(F.struct("score", "node", "n", "comp")).alias("hub"))
        met = mixed.join(center, "k").where(F.col("comp") != F.col("hub.comp"))
        star = met.where(_alike(F.col("n"), F.col("hub.n"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
        new = _linked(star.distinct(), sets)
        links = new if links is None else written(links.unionByName(new), "links")
        comps = components(links)
    # Then all pairs that can be similar among the texts that share a band with one of another component.
    joined = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    apart = written(_mixed(joined).select("node", "n", "comp").distinct(), "apart")
    links = written(links.unionByName(_linked(_prefix_pairs(apart, sets), sets)), "links")
    comps = components(links)
    named = texts.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", F.col("node").alias("row"))).alias("best")
    size = F.sum("copies").alias("class_size")
    heads = named.groupBy("comp").agg(best, size)
    of_text = named.join(heads, "comp").select(
        F.col("digest").alias("d"), F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("head"), "class_size"
    )
    placed = signed.where("n > 0").join(of_text, F.col("digest") == F.col("d"))
    alone = signed.where("n = 0").select(
        "doc_id", "digest", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept")
    )
    out = placed.select("doc_id", "digest", "class_id", "class_size", (F.col("row") == F.col("head")).alias("kept"))
    return out.unionByName(alone), links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept. See `classes`."""
    return classes(docs, doc_id, text)[0].drop("digest")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each class, with all their columns."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(doc_id).alias("id"),
        F.unhex(F.sha2(_words(text), 256)).alias("d"),
    )
    stay = classes(docs, doc_id, text)[0].where("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("d") == F.col("digest"))
    # Repeated rows of a kept document: as many stay as were kept (one; all of those without words).
    rank = F.row_number().over(Window.partitionBy("id", "d").orderBy("d"))
    return rows.join(stay, same).withColumn("rank", rank).where("rank <= n").select("doc.*")


def brute_links(texts: Iterable[str]) -> set[tuple[int, int]]:
    """All similar pairs by comparing each with each; for tests."""
    sets = [shingles([" ".join(t.lower().split())])[1] for t in texts]
    n = range(len(sets))
    return {(i, j) for i in n for j in n if i < j and jaccard(sets[i], sets[j]) >= SIMILAR}
