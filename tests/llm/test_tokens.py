from __future__ import annotations

import random

import pytest
from helpers import LONG, documents, hostile

from pageloom.llm import token_counts

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return lambda t: len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids)


def test_hostile(spark, library):
    docs = hostile(spark).union(documents(spark, ["x<|endoftext|><|endoftext|> y", "aaaa" * 99]))
    got = token_counts.token_counts(docs, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(r.doc_id, len((r.text or "").encode()), library(r.text)) for r in docs.collect()]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert {r.doc_id: r.over_limit for r in got.collect()}[5]
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0


def test_random_texts(library, monkeypatch):
    random.seed(6)
    letters = list("aaaabbbcc   \n\t''sstdlrevm123456éßñ漢字🙂\x1c\x1d\x85  ​\x00̀ǅⅧ²")
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(300)]
    words = token_counts.Vocabulary(PATH)
    assert words.counts(texts) == [library(t) for t in texts]
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    monkeypatch.setattr(token_counts, "AT_ONCE", 50)
    small = token_counts.Vocabulary(PATH)
    assert [n for part in token_counts._portions(texts) for n in small.counts(part)] == words.counts(texts)
    assert small.counts([LONG]) == [library(LONG)]
