"""A manifest of a data set: each row a leaf of a hash tree, with proofs that a row belongs to it.

The rows of a group (a source) in key order are the leaves of the group's tree, whose top is the subroot; the subroots
in group order are the leaves of one more tree, whose top is the root. Every FAN neighbouring nodes have one parent.

Proofs come from one multiproof a leaf partition, not from a walk up for each leaf. A partition holds BLOCK neighbouring
leaves, so that whole subtrees lie inside it. Which nodes outside it are missing for all its proofs follows from its
number and the group's size: the sisters on the way from the partition's top to the root, at most FAN - 1 a level. They
are fetched by one join, interior nodes are computed once in the task, and each leaf's proof is put together from them.

No step holds a group: places come from counts a range partition, nodes above the partitions from rounds that each
make the nodes BLOCK times fewer.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.llm.common import written

FAN = 3
#: Levels inside a leaf partition, and so its leaves.
HEIGHT = 7
#: No tree has more levels: FAN to this power is beyond a long.
LEVELS = 33
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, level long, at long, n long, digest string"


def encoded(value: Column) -> Column:
    """A value as it stands in a leaf: its bytes in UTF-8, counted; null is a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda x, level: F.sha2(F.concat(level["before"], x, level["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof in one string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), "")


def _parents(nodes: list[str]) -> list[str]:
    return [sha256("".join(nodes[k : k + FAN]).encode()).hexdigest() for k in range(0, len(nodes), FAN)]


def _levels(nodes: list[str], most: int, alone: bool) -> list[list[str]]:
    """Nodes and what stands above them, up to `most` levels; a whole tree (alone) ends where one node remains."""
    levels = [nodes]
    while len(levels) <= most and not (alone and len(levels[-1]) == 1):
        levels.append(_parents(levels[-1]))
    return levels


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves(grp, key, digest, claim) as written rows (tree, at, n, grp, key, digest, claim) and groups (tree, grp, n).

    tree is the group's number in group order, at the leaf's in key order (equal keys: by digest), n the group's size.
    Rows are dealt by ranges, so numbers are counts of the partitions before plus a number within one; a group that
    holds most rows lies in many partitions.
    """
    spread = leaves.withColumn("tie", F.monotonically_increasing_id())  # equal rows, too, lie in many partitions
    ranged = written(
        spread.repartitionByRange("grp", "key", "digest", "tie").withColumn("part", F.spark_partition_id()).drop("tie"),
        "ranged",
    )
    of_group = W.partitionBy("grp")
    counts = ranged.groupBy("part", "grp").agg(F.count("*").alias("here"))
    counts = counts.select(
        "*",
        (F.sum("here").over(of_group.orderBy("part")) - F.col("here")).alias("earlier"),
        F.sum("here").over(of_group).alias("n"),
    )
    counts = written(counts, "counts")
    # Groups are numbered in the partition they begin in; there is one row a partition in the window over all.
    begun = counts.where(F.col("earlier") == 0)
    by_part = begun.groupBy("part").agg(F.count("*").alias("begin"))
    before = by_part.select("part", (F.sum("begin").over(W.orderBy("part")) - F.col("begin")).alias("groups_before"))
    number = F.row_number().over(W.partitionBy("part").orderBy("grp")) - 1
    groups = begun.withColumn("number", number).join(before, "part")
    groups = written(groups.select((F.col("number") + F.col("groups_before")).cast("long").alias("tree"), "grp", "n"), "groups")
    sized = counts.join(groups.drop("n"), counts["grp"].eqNullSafe(groups["grp"])).select(
        "part", counts["grp"].alias("grp"), "earlier", "n", "tree"
    )
    numbered = ranged.withColumn("nth", F.row_number().over(W.partitionBy("part", "grp").orderBy("key", "digest")))
    met = numbered.alias("r").join(
        sized.alias("s"), (F.col("r.part") == F.col("s.part")) & F.col("r.grp").eqNullSafe(F.col("s.grp"))
    )
    rows = met.select(
        "tree", (F.col("earlier") + F.col("nth") - 1).alias("at"), "n", F.col("r.grp").alias("grp"), "key", "digest", "claim"
    )
    return written(rows, "placed"), groups


def _risen(nodes: DataFrame, level: int, height: int, told: str) -> DataFrame:
    """Nodes(tree, at, n, digest) of one level, risen block by block up to `height` levels; n counts a tree's nodes there.

    Gives rows of NODE: the blocks' tops only ("top"), what is above the given nodes ("above"), or all of it ("all").
    """
    block = FAN**height

    def up(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        n = int(part["n"].iat[0])
        levels = _levels(part["digest"].tolist(), height, n <= block)
        begin = {"top": len(levels) - 1, "above": 1, "all": 0}[told]
        made = [
            (key[0], level + k, key[1] * FAN ** (height - k) + i, -(-n // FAN**k), digest)
            for k in range(begin, len(levels))
            for i, digest in enumerate(levels[k])
        ]
        return pd.DataFrame(made, columns=["tree", "level", "at", "n", "digest"])

    blocks = nodes.select("tree", F.floor(F.col("at") / block).alias("block"), "at", "n", "digest")
    return blocks.groupBy("tree", "block").applyInPandas(up, NODE)


def _climbed(leaves: DataFrame, most: int, height: int, told: str) -> DataFrame:
    """Nodes of trees given by their leaves(tree, at, n, digest), the largest of `most`: all, or from `height` on.

    Each round makes the nodes of `height` more levels. A tree's top is its node with n = 1.
    """
    rounds, level = [written(_risen(leaves, 0, height, told), "nodes")], height
    while most > FAN**level:
        wide = rounds[-1].where((F.col("level") == level) & (F.col("n") > 1))
        rounds.append(written(_risen(wide, level, height, "above"), "nodes"))
        level += height
    return reduce(DataFrame.unionByName, rounds)


def _sisters(at: Column, n: Column, level: Column) -> Column:
    """Numbers of the other nodes below the same parent."""
    width = F.ceil(n / F.pow(F.lit(float(FAN)), level)).cast("long")
    begin = F.floor(at / FAN) * FAN
    return F.filter(F.sequence(begin, F.least(begin + FAN - 1, width - 1)), lambda x: x != at)


def _way(n: Column, number: Column, lowest: int) -> Column:
    """array<struct<level, at>> of the nodes missing on the way from node `number` of level `lowest` to the top."""
    levels = F.filter(F.sequence(F.lit(lowest), F.lit(LEVELS)), lambda k: n > F.pow(F.lit(float(FAN)), k))

    def missing(level: Column) -> Column:
        at = F.floor(number / F.pow(F.lit(float(FAN)), level - lowest)).cast("long")
        return F.transform(
            _sisters(at, n, level), lambda x: F.struct(level.cast("long").alias("level"), x.cast("long").alias("at"))
        )

    return F.flatten(F.transform(levels, missing))


def _missing(groups: DataFrame, trees: int, nodes: DataFrame, height: int) -> DataFrame:
    """Rows (tree, block, top, level, at, digest): the nodes outside each leaf partition that its proofs need.

    top tells the nodes of the tree over the groups from those of the group's own.
    """
    last = F.ceil(F.col("n") / float(FAN**height)).cast("long") - 1
    blocks = groups.select("tree", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    own = blocks.select("tree", "block", F.col("tree").alias("of"), F.inline(_way(F.col("n"), F.col("block"), height)))
    over = blocks.select(
        "tree", "block", F.lit(-1).cast("long").alias("of"), F.inline(_way(F.lit(trees), F.col("tree"), 0))
    )
    wanted = own.unionByName(over)
    known = nodes.select(F.col("tree").alias("of"), "level", "at", "digest")
    return wanted.join(known, ["of", "level", "at"]).select(
        "tree", "block", (F.col("of") < 0).alias("top"), "level", "at", "digest"
    )


def proofs(
    docs: DataFrame,
    claim: Column | None = None,
    key: str = "doc_id",
    group: str = "source",
    fields: tuple[str, ...] = FIELDS,
    height: int = HEIGHT,
) -> DataFrame:
    """One row per row of docs: the key and group columns, leaf, claim, subroot, root and proof.

    proof is an array of (before, after), from the leaf up: the digests of the sisters left and right of the way to the
    root, written one after another; `folded` computes the root from it. claim is a column of docs with a digest that
    somebody presents as the leaf's, kept for `folded`; by default the leaf.

    Nulls in any field are hashed as such; a null group comes first, a null key before the others. Rows with one key
    follow by digest, and equal rows are leaves of their own whose proofs may be exchanged. Empty and long texts enter
    only through their digest. An empty table gives no rows; other columns are ignored.
    """
    hashed = leaf(*[F.col(c) for c in fields])
    leaves = docs.select(
        F.col(group).alias("grp"), F.col(key).alias("key"), hashed.alias("digest"), (hashed if claim is None else claim).alias("claim")
    )
    rows, groups = placed(leaves)
    trees, most = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    nodes = _climbed(rows, most, height, "top")
    subroots = nodes.where(F.col("n") == 1).select(
        F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).alias("n"), "digest"
    )
    nodes = nodes.unionByName(_climbed(subroots, trees, height, "all"))
    missing = _missing(groups, trees, nodes, height)
    block = FAN**height

    def expand(_: tuple, part: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        n, tree, number = int(part["n"].iat[0]), int(part["tree"].iat[0]), int(part["at"].iat[0]) // block
        known = {(bool(t), int(k), int(i)): d for t, k, i, d in zip(*[outside[c] for c in ("top", "level", "at", "digest")], strict=True)}
        levels = _levels(part["digest"].tolist(), height, n <= block)
        before, after = [[] for _ in levels[0]], [[] for _ in levels[0]]
        for k, nodes in enumerate(levels[:-1]):
            for i in range(len(levels[0])):
                at = i // FAN**k
                start = at // FAN * FAN
                before[i].append("".join(nodes[start:at]))
                after[i].append("".join(nodes[at + 1 : start + FAN]))
        here, tails = levels[-1][0], ([], [])
        tops = []
        # From the partition's top to the group's, and from there to the root.
        for top, at, count in ((False, number, -(-n // block)), (True, tree, trees)):
            level = 0 if top else height
            while count > 1:
                start = at // FAN * FAN
                left = "".join(known[top, level, x] for x in range(start, at))
                right = "".join(known[top, level, x] for x in range(at + 1, min(start + FAN, count)))
                here = sha256((left + here + right).encode()).hexdigest()
                tails[0].append(left)
                tails[1].append(right)
                at, count, level = at // FAN, -(-count // FAN), level + 1
            tops.append(here)
        return pd.DataFrame(
            {
                "key": part["key"],
                "grp": part["grp"],
                "leaf": part["digest"],
                "claim": part["claim"],
                "subroot": tops[0],
                "root": tops[1],
                "before": [x + tails[0] for x in before],
                "after": [x + tails[1] for x in after],
            }
        )

    # Keys travel as text: pandas would turn long numbers with nulls among them into floats.
    of_block = F.floor(F.col("at") / block).alias("block")
    dealt = rows.select(
        "tree", of_block, "at", "n", F.col("key").cast("string"), F.col("grp").cast("string"), "digest", "claim"
    )
    strings = "key string, grp string, leaf string, claim string, subroot string, root string, before array<string>, after array<string>"
    both = dealt.groupBy("tree", "block").cogroup(missing.groupBy("tree", "block"))
    out = both.applyInPandas(expand, strings)
    kinds = {f.name: f.dataType for f in docs.select(group, key).schema}
    return out.select(
        F.col("key").cast(kinds[key]).alias(key),
        F.col("grp").cast(kinds[group]).alias(group),
        "leaf",
        "claim",
        "subroot",
        "root",
        F.transform(F.arrays_zip("before", "after"), lambda x: F.struct(x["before"].alias("before"), x["after"].alias("after"))).alias("proof"),
    )
