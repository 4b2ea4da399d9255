"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

A window is a run of item words. Of its shingles (word pairs; single words for windows of one word) the rarest over
all documents is its necessary prefix token: where the window occurs, that shingle occurs. Document positions are
joined on these tokens alone, position and length bounds follow, and the window's words are compared exactly.
The windows, a stated query set, are broadcast in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.rows import exploded
from pageloom.llm.common import whole, written

#: Consecutive item words in a window; a shorter item is one window.
WINDOW = 10
#: Windows (or shingles) broadcast at once: about 300 bytes each, so at most some 60 MB. More are taken in turn.
BLOCK = 200_000
#: What separates words once A-Z are small.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column | str) -> Column:
    """The words of a text: A-Z in small letters, runs of 0-9, a-z and characters above 0x7F."""
    spaced = F.regexp_replace(F.translate(whole(text), _UPPER, _UPPER.lower()), _GAP, " ")
    return F.filter(F.split(F.trim(spaced), " ", -1), lambda w: w != "")


def windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct windows: wid, win (its words), items (ids having it, sorted). Written, so that wid is settled."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), words(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1)))
    each = exploded(rows, starts, "item", "w").withColumnRenamed("e", "s").select(
        "item", F.slice("w", F.col("s"), F.least(F.lit(WINDOW), F.size("w"))).alias("win")
    )
    distinct = each.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return written(distinct.select(F.monotonically_increasing_id().alias("wid"), "win", "items"), "windows")


def _shingles(w: Column, size: int) -> Column:
    """Hashes of the shingles at positions 0, 1, ..., of a word array."""
    if size == 1:
        return F.transform(w, lambda x: F.xxhash64(x))
    pairs = F.sequence(F.lit(0), F.size(w) - 2)
    made = F.transform(pairs, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
    return F.when(F.size(w) >= 2, made).otherwise(F.expr("cast(array() as array<bigint>)"))


def _positions(docs: DataFrame, size: int) -> DataFrame:
    """Each shingle of each document: id, th, w (the words), pos, h."""
    rows = docs.withColumn("h", _shingles(F.col("w"), size))
    return exploded(rows, "h", "id", "th", "w").withColumnRenamed("e", "h")


def _blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """`df` in parts small enough to broadcast."""
    n = -(-df.count() // BLOCK)
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) if n > 1 else df for i in range(n)]


def hits(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """Verified occurrences: id, th (hash of the text), start, len, items."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(whole(text)).alias("th"), words(text).alias("w"))
    table = windows(items, item_id, item_text)
    found = []
    for size in [r["size"] for r in table.select(F.least(F.size("win"), F.lit(2)).alias("size")).distinct().collect()]:
        own = table.where(F.least(F.size("win"), F.lit(2)) == size)
        tokens = exploded(own, _shingles(F.col("win"), size), "wid").toDF("wid", "off", "h")
        positions = _positions(rows, size)
        # How often each shingle of a window occurs in all documents; one that never does rules the window out.
        counts = [
            positions.select("h").join(F.broadcast(part), "h").groupBy("h").agg(F.count("*").alias("n"))
            for part in _blocks(tokens.select("h").distinct(), "h")
        ]
        if not counts:
            continue
        rarity = written(reduce(DataFrame.unionByName, counts), "rarity")
        known = tokens.join(rarity, "h", "left").groupBy("wid")
        rarest = known.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("t")).where("t.n > 0")
        prefix = written(
            rarest.join(own, "wid").select("wid", F.col("t.h").alias("h"), F.col("t.off").alias("off"), "win", "items"),
            "prefix",
        )
        for part in _blocks(prefix, "wid"):
            start, n = F.col("pos") - F.col("off"), F.size("win")
            found.append(
                positions.join(F.broadcast(part), "h")
                .where((start >= 0) & (start + n <= F.size("w")))
                .where(F.slice("w", start + 1, n) == F.col("win"))
                .select("id", "th", start.alias("start"), n.alias("len"), "items")
            )
    if not found:
        none = table.sparkSession.createDataFrame([], "start int, len int, items array<string>")
        return rows.select("id", "th").crossJoin(none.limit(0))
    return reduce(DataFrame.unionByName, found)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    Null and empty texts have no words and are clean; items without words have no windows. Repeated rows get one
    row each, with equal values; repeated items count once. Empty tables on either side give no hits.
    """
    found = hits(docs, items, doc_id, text, item_id, item_text).groupBy("id", "th")
    spans = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))
    per_doc = found.agg(
        F.collect_set(F.struct("start", "len")).alias("spans"), F.collect_set("items").alias("items")
    ).select(
        "id",
        "th",
        F.size(F.array_distinct(spans)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    )
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(whole(text)).alias("hash"),
        F.regexp_count(whole(text), F.lit(_WORD)).cast("long").alias("n_words"),
    )
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a hit, with all their columns."""
    dirty = hits(docs, items, doc_id, text, "item_id", "text").select("id", "th").distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(whole(text)).alias("hash"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th"))
    return rows.join(dirty, same, "left_anti").select("doc.*")
