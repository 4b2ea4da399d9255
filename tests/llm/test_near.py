from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import HERE, SF, documents, hostile

from pageloom.llm import near_dedup as nd
from pageloom.llm.components import components


def brute_classes(ids, texts):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in nd.brute_links([t or "" for t in texts]):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    out = {}
    for i in range(len(ids)):
        own = [ids[j] for j in range(len(ids)) if root(j) == root(i) and ids[j] is not None]
        out.setdefault(ids[i], []).append(min(own) if own else None)
    return out


def copies(n, seed):
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    out = []
    for _ in range(n):
        base = [word() for _ in range(random.randint(3, 120))]
        for _ in range(random.randint(1, 6)):
            own = list(base)
            for _ in range(random.randint(0, 3)):
                own[random.randrange(len(own))] = word()
            out.append(" ".join(own))
    return out


def check(spark, ids, texts):
    got = {}
    for r in nd.near_duplicates(documents(spark, texts, ids).repartition(4)).collect():
        got.setdefault(r.doc_id, []).append(r.class_id)
    want = brute_classes(ids, texts)
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()}


def test_equals_brute_force(spark):
    texts = copies(30, 5)
    check(spark, list(range(len(texts))), texts)


def test_changed_copies_and_common_passages(spark):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    passage, base = [word() for _ in range(90)], [word() for _ in range(100)]
    texts = [" ".join(passage + [word() for _ in range(15)]) for _ in range(40)]
    for n in (1, 2, 3, 4, 5) * 8:  # from similar to not similar any more
        own = list(base)
        for at in random.sample(range(100), n):
            own[at] = word()
        texts.append(" ".join(own))
    random.shuffle(texts)
    check(spark, list(range(len(texts))), texts)


def test_texts_that_repeat_shingles_differently_meet(spark):
    random.seed(21)
    words = lambda n: ["".join(random.choices("abcdefgh", k=6)) for _ in range(n)]
    texts = []
    for c in (10, 100, 300) * 6:  # a copy with a line more, repeated c times
        base = words(100)
        texts += [" ".join(base), " ".join(base + words(18) * c)]
    for _ in range(6):  # the same shingles, but for those around the repeated halves
        a, b = words(100), words(100)
        texts += [" ".join(a * 100 + b * 2), " ".join(a * 2 + b * 100)]
    assert len(nd.brute_links(texts)) == len(texts) / 2
    check(spark, list(range(len(texts))), texts)


def test_prefix_pairs_lose_no_link(spark):
    texts = copies(25, 11)
    sets = spark.createDataFrame([(i, nd.shingles([t])[1].astype("int64").tolist()) for i, t in enumerate(texts)], "node long, h array<long>")
    nodes = sets.selectExpr("node", "size(h) n", "node comp")
    got = {(min(r), max(r)) for r in nd._prefix_pairs(nodes, sets).collect()}
    assert nd.brute_links(texts) <= got and len(got) < len(texts) ** 2 / 8


def test_hostile(spark):
    docs = hostile(spark)
    out = nd.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    by_id = {r.doc_id: r for r in out}
    assert by_id[0].class_id == 0 and by_id[1].class_id == 1 and by_id[2].class_id == 2  # no words: each alone
    assert by_id[3].class_id == by_id[4].class_id == by_id[None].class_id == 3 and by_id[3].class_size == 4
    assert by_id[8].class_id == 7
    assert sum(r.kept for r in out if r.class_id == 3) == 1
    stay = nd.deduplicated(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == [0, 1, 2, 3, 5, 6, 7, 9]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    random.seed(1)
    words = ["".join(random.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = [" ".join(words), " ".join(words[:270] + words[:60])]
    place, made, letters = nd.shingles(texts)
    many = np.mean(
        [
            (f[0] == f[1]).mean()
            for salt in range(20)
            for f in [nd.registers(place, made ^ np.uint64(salt * 7919), nd.weights(letters), 2)]
        ]
    )
    x, y = ({h: w for h, w in zip(made[place == i], nd.weights(letters[place == i]), strict=True)} for i in (0, 1))
    true = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})
    assert abs(many - true) < 0.03


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not HERE, reason="driver tables are not here")
def test_recall_of_bands_on_the_driver_table(spark):
    texts = sorted({" ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} - {""})
    place, made, letters = nd.shingles(texts)
    assert len({*nd.weights(letters).round(3).tolist()}) > 10
    own = nd.bands(nd.registers(place, made, nd.weights(letters), len(texts)))
    links = nd.brute_links(texts)
    met = sum(bool((own[a] == own[b]).any()) for a, b in links)
    assert links and met >= 0.99 * len(links)
