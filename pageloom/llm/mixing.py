"""Mixing sources to target weights by Poisson replication.

A source with weight w of the target and n of N documents is repeated w * N / n times on average. Each document's
count is a Poisson draw with that mean, by inversion of a uniform number hashed from seed and doc_id: the same at
every run, on any machine, for any split of the table. Copies are dealt out globally by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import written

#: Largest mean inverted at once; a larger one is the sum of equal parts, each drawn by a hash of its own.
PART = 64.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts, joined by `|`."""
    hexed = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def rates(docs: DataFrame, weights: DataFrame, source: str = "source") -> DataFrame:
    """Per source: source, mean repetition rate and the Poisson distribution function as an array, from 0 on.

    weights: source, weight (any positive scale; null or absent counts as 0, repeated rows add up). Null is a source
    like any other. Shares refer to the documents of the sources that have a weight.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    wanted = weights.groupBy(F.col("source").alias("wanted")).agg(F.sum("weight").alias("weight"))
    both = sizes.join(wanted, F.col("source").eqNullSafe(F.col("wanted"))).where("weight > 0")
    total = both.agg(F.sum("n").alias("docs"), F.sum("weight").alias("weights"))
    mean = both.crossJoin(F.broadcast(total)).select(  # one row
        "source", (F.col("weight") / F.col("weights") * F.col("docs") / F.col("n")).alias("rate")
    )
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    with_parts = mean.select("source", "rate", parts.alias("parts"), (F.col("rate") / parts).alias("mean"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int"))
    first = F.exp(-F.col("mean"))
    cdf = F.aggregate(
        steps,
        F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("cdf")),
        lambda a, k: F.struct(
            (a["p"] * F.col("mean") / k).alias("p"),
            (a["sum"] + a["p"] * F.col("mean") / k).alias("sum"),
            F.array_append(a["cdf"], a["sum"] + a["p"] * F.col("mean") / k).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )
    return written(with_parts.select("source", "rate", "parts", cdf.alias("cdf")), "rates")


def mixed(
    docs: DataFrame, weights: DataFrame, seed: int = 1, doc_id: str = "doc_id", source: str = "source"
) -> DataFrame:
    """All columns of the documents, each row as often as drawn, plus copy_no (from 0), repeats, mix_key; shuffled.

    Sources without a weight get no rows. Repeated rows of one doc_id draw equally. Rows without a doc_id draw by all
    that they hold. Other texts are not read, so null, empty and long ones need no rule. mix_key orders the result: partitions are dealt
    by it and sorted by it. If documents have columns of these three names, theirs are replaced.
    """
    means = rates(docs, weights, source)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("copy_no", "repeats", "mix_key")])
    key = F.col("mix_doc_id")
    rows = docs.select(
        whole.alias("doc"),
        F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null"), F.md5(F.to_json(whole)))).alias("mix_doc_id"),
        F.col(source).alias("mix_source"),
    )
    # No hint: the written table's size decides whether it is broadcast; else a hot source is split by the skew join.
    joined = rows.join(means, F.col("mix_source").eqNullSafe(F.col("source")))
    draws = F.transform(
        F.sequence(F.lit(1), F.col("parts")),
        lambda j: F.size(
            F.filter("cdf", lambda c: c < uniform(F.lit(f"mix{seed}"), j.cast("string"), key))
        ),
    )
    counted = joined.withColumn("repeats", F.aggregate(draws, F.lit(0), lambda a, x: a + x)).where("repeats > 0")
    copies = counted.select(
        "doc", "mix_doc_id", "repeats", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("copy_no")
    )
    order = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.col("copy_no").cast("string"), key))
    return (
        copies.select("doc", "repeats", "copy_no", order.alias("mix_key"))
        .repartition("mix_key")
        .sortWithinPartitions("mix_key")
        .select("doc.*", "copy_no", "repeats", "mix_key")
    )


def tempered(docs: DataFrame, power: float = 0.5, source: str = "source") -> DataFrame:
    """Target weights in proportion to each source's number of documents to a power under 1: small sources gain."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.pow(F.count("*"), F.lit(power)).alias("weight"))
