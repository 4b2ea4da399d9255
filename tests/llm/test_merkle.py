from __future__ import annotations

from hashlib import sha256
from itertools import groupby

import pytest
from helpers import HERE, SF, documents, hostile
from pyspark.sql import functions as F

from pageloom.llm import merkle
from pageloom.llm.queries import QUERIES


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text=None):
    values = [r.doc_id, r.source, r.lang, r.n_chars, r.text if text is None else text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The top, and for each leaf its sisters level by level."""
    ways, owner = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(owner):
            start = at // 3 * 3
            ways[i].append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + 3])))
            owner[i] = at // 3
        nodes = [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], ways


def brute(rows, tampered=lambda r: False):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of each row, by definition."""
    order = lambda r: (r.source is not None, (r.source or "").encode(), r.doc_id is not None, r.doc_id or 0, leaf(r))
    groups = [list(g) for _, g in groupby(sorted(rows, key=order), key=lambda r: r.source)]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    if not groups:
        return []
    root, over = tree([t for t, _ in trees])
    out = []
    for g, (subroot, ways), up in zip(groups, trees, over, strict=True):
        for r, way in zip(g, ways, strict=True):
            here = leaf(r, r.text.replace("\n", "") if r.text is not None and tampered(r) else None)
            for left, right in way + up:
                here = H(left, here, right)
            out.append((r.doc_id, leaf(r), subroot, root, H(*[x for pair in way + up for x in pair]), here, here == root))
    return out


def got(found):
    folded = merkle.folded(F.col("claim"), F.col("proof"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256), folded, folded == F.col("root"))
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [3], [1, 1], [10, 1, 28, 4], [82], [2] * 30])
def test_trees_of_many_sizes(spark, sizes):
    """Partitions of 3 leaves: trees of one node, of one partition, of several rounds."""
    parts = [documents(spark, [f"t{k} {i}" for i in range(n)], source=f"s{k}", clash=False) for k, n in enumerate(sizes)]
    docs = parts[0]
    for part in parts[1:]:
        docs = docs.union(part)
    assert got(merkle.proofs(docs, height=1)) == sorted(brute(docs.collect()), key=repr)


def test_hostile(spark):
    docs = hostile(spark).union(documents(spark, ["a", "b", None, "b"], [7, None, None, 2**60 + 1], source=None))
    docs = docs.union(documents(spark, ["x"], [1], source="é")).union(documents(spark, ["x"], [1], source="z"))
    want = sorted(brute(docs.collect()), key=repr)
    assert got(merkle.proofs(docs, height=2)) == want == got(merkle.proofs(docs))
    assert merkle.proofs(docs.limit(0)).count() == 0
    same = documents(spark, ["same"] * 50, [4] * 50)
    assert got(merkle.proofs(same, height=2)) == sorted(brute(same.collect()), key=repr)


def test_a_changed_leaf_is_found(spark):
    docs = documents(spark, ["a\nb", "c"], [1, 2])
    claim = merkle.leaf(*[F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.FIELDS])
    assert {r[0]: r[-1] for r in got(merkle.proofs(docs, claim))} == {1: False, 2: True}


@pytest.mark.skipif(not HERE, reason="driver tables are not here")
def test_query(spark):
    from zlib import crc32

    want = brute(spark.read.parquet(f"{SF}/documents.parquet").collect(), lambda r: crc32(str(r.doc_id).encode()) % 2 == 0)
    found = QUERIES["op13_merkle_manifest"](spark, SF)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert {r[-1] for r in want} == {True, False}
