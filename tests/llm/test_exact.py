from __future__ import annotations

import hashlib
import re

from helpers import documents, hostile, rows

from pageloom.llm import exact_dedup


def brute(data):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in data]
    out = []
    for t in norm:
        same = [i for (i, _), u in zip(data, norm, strict=True) if u == t]
        ids = [i for i in same if i is not None]
        out.append((min(ids) if ids else None, len(same), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_hostile(spark):
    docs = hostile(spark)
    data = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_duplicates(docs).collect()), key=repr
    )
    assert got == sorted(((i, *b) for (i, _), b in zip(data, brute(data), strict=True)), key=repr)


def test_one_row_of_each_group_stays(spark):
    docs = hostile(spark)
    out = exact_dedup.exact_duplicates(docs)
    groups = out.select("text_sha256").distinct().count()
    assert out.where("kept").count() == groups
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns and stay.count() == groups
    assert {r.doc_id for r in stay.collect()} == {r.doc_id for r in out.where("kept").collect()}


def test_frequent_and_rare_groups(spark):
    texts = ["hot  text"] * 700 + ["warm"] * 40 + [f"single {i}" for i in range(500)] + ["hot\ttext"] * 3
    docs = documents(spark, texts, clash=False).repartition(7)
    out = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert out[5].keep_id == 0 and out[5].group_size == 703 and not out[5].kept and out[0].kept
    assert out[1240].keep_id == 0 and out[739].keep_id == 700 and out[800].kept
    assert exact_dedup.deduplicated(docs).count() == 502


def test_empty_table(spark):
    docs = hostile(spark).limit(0)
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert not rows(exact_dedup.deduplicated(docs))
