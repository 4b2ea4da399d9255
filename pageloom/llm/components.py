"""Connected components of a table of links, by passing on the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node of its component) for links a, b. Nodes without a link do not appear.

    Each round every node takes the smallest label around it and then that label's own label, so long chains shorten
    by half; partial sums come before each shuffle, so a node with very many links is no hot spot. Labels are written
    after each round.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels"
    )
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        taken = labels.join(around, F.col("node") == F.col("a")).select(
            "node", F.least("comp", "near").alias("low"), F.col("comp").alias("old")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("lower"))
        new = written(
            taken.join(jump, "low").select("node", F.least("low", "lower").alias("comp"), "old"), "labels"
        )
        moved = new.where("comp < old").limit(1).count()
        labels = new.select("node", "comp")
        if not moved:
            return labels
