"""Exact duplicates by a heavy-hitter split.

A Misra-Gries type sketch (Spark's `approx_top_k`) names the digests that may be frequent. Their true counts and
winners are computed by partial sums and broadcast, so rows of a frequent text are settled where they lie; only the
remaining digests, each bounded in frequency by the sketch's guarantee, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import whole, written

#: Counters of the sketch: a digest on more than about 1/COUNTERS of the rows is always found.
COUNTERS = 4096
#: Digests taken from the sketch, and so the bound on the rows that are broadcast (about 100 bytes each).
HEAVY = 1024


def normalised(text: Column | str) -> Column:
    """The text whose equality counts: each run of ASCII white space is one space, null is empty."""
    return F.regexp_replace(whole(text), "[ \\x09-\\x0D]+", " ")


def digest(text: Column | str) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def winners(digests: DataFrame) -> DataFrame:
    """Of the digests that may be frequent: number of rows and the smallest (is null, doc_id, row). At most HEAVY rows."""
    sketch = digests.select(F.xxhash64("digest").alias("h")).agg(
        F.expr(f"approx_top_k(h, {HEAVY}, {COUNTERS})").alias("top")
    )
    frequent = sketch.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("h"))
    return (
        digests.withColumn("h", F.xxhash64("digest"))
        .join(F.broadcast(frequent), "h", "left_semi")
        .groupBy("digest")
        .agg(F.min(_order()).alias("best"), F.count("*").alias("n"))
    )


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("row"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are. The row with the smallest doc_id stays; null doc_ids come after
    all others, and of repeated rows with that doc_id one stays. Null texts count as empty; empty texts equal each
    other. An empty table gives an empty table. Other columns are ignored.
    """
    table = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            digest(text).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    tagged = table.join(F.broadcast(winners(table)), "digest", "left")
    same = Window.partitionBy("digest")
    light = tagged.where("best is null").select(
        "doc_id", "digest", "row", F.min(_order()).over(same).alias("best"), F.count("*").over(same).alias("n")
    )
    heavy = tagged.where("best is not null").select("doc_id", "digest", "row", "best", "n")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; same choice as `exact_duplicates`.

    Rows of a frequent text are dropped in place but for those with the winning doc_id; the rest meet by digest.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(doc_id).alias("doc_id"),
        digest(text).alias("digest"),
    )
    table = written(
        rows.select("doc_id", "digest", F.monotonically_increasing_id().alias("row")), "digests"
    )
    best = winners(table).select("digest", "best")
    tagged = rows.join(F.broadcast(best), "digest", "left")
    left = tagged.where(F.col("best").isNull() | F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    # Row number 1 is also taken before the shuffle, so each task sends one row of a digest at most.
    first = Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last())
    return left.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("doc.*")
