from __future__ import annotations

import random
import re

from helpers import LONG, documents

from pageloom.llm import decontaminate

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def brute(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for s in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return out


def check(spark, docs, items):
    have = documents(spark, [t for _, t in docs], [i for i, _ in docs])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in decontaminate.contamination(have, bench).collect()]
    want = brute(docs, items)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    clean = decontaminate.clean(have, bench)
    assert clean.columns == have.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((w[0] for w in want if not w[5]), key=repr)


def test_hostile(spark):
    texts = [None, "", "x " + ITEM.upper() + " y", ITEM, ITEM, "one two three", "É été", LONG, "word word word", ITEM[:20]]
    items = [(0, ITEM), (1, ITEM), (2, "Word"), (3, None), (4, ""), (5, "É été"), (6, "lang lang lang"), (2, "Word")]
    check(spark, list(zip([0, 1, 2, 3, 3, None, 5, 6, 7, 8], texts, strict=True)), items)


def test_random(spark):
    random.seed(4)
    text = lambda n: " ".join(random.choice("abc") for _ in range(n))
    docs = [(i, text(random.randint(0, 60))) for i in range(60)]
    check(spark, docs, [(i, text(random.randint(0, 16))) for i in range(12)])


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    test_random(spark)


def test_empty_tables(spark):
    check(spark, [(1, ITEM)], [(1, "")])
    docs, items = documents(spark, [ITEM]), spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).first().contaminated is False
