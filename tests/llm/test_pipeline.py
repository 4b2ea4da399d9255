"""The pipeline's stages, each against a brute-force version on what the one before kept."""

from __future__ import annotations

import re

import pytest
from helpers import HERE, SF
from test_decontaminate import brute as leaks
from test_near import brute_classes

import corpus_pipeline as cp
from pageloom.llm import toxicity
from pageloom.llm.common import written

pytestmark = pytest.mark.skipif(not HERE, reason="driver tables are not here")


def test_stages(spark):
    docs = cp.table(spark, SF, "documents")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in cp.table(spark, SF, "benchmark").collect()]
    for name, stage in cp.STAGES:
        before = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
        if name == "toxicity":
            scores = toxicity.scored(docs, cp.toxicity_model(spark, docs, SF))
            want = [r.doc_id for r in scores.orderBy("doc_id").collect() if r.score < cp.REJECT]
        elif name == "exact_dedup":
            first = {}
            for i, t in before:
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
            want = sorted(first.values())
        elif name == "near_dedup":
            want = sorted(i for i, c in brute_classes(*map(list, zip(*before, strict=True))).items() if c == [i])
        elif name == "decontamination":
            want = [w[0] for w in leaks(before, bench) if not w[5]]
        docs = written(stage(spark, docs, SF), name)
        if name != "mixing":
            assert docs.columns == columns
            assert [r.doc_id for r in docs.orderBy("doc_id").collect()] == want
    ids = {i for i, _ in before}
    assert {r.doc_id for r in docs.collect()} <= ids and docs.count() > 0.7 * len(ids)
    assert cp.ORACLE_SQL is None
    assert cp.run(spark, SF).count() == docs.count()
