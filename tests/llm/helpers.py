"""Hostile tables and counting helpers for the operators' tests."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

SF = "/root/testdata/sf0.001"
HERE = Path(SF).exists()
LONG = "lang " * 30_000
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
CLASH = (
    "doc string, n string, h string, node string, row string, digest string, k string, comp string, id string, "
    "th string, w string, spans string, best string, rank string, repeats string, copy_no string, mix_key string"
)


def documents(spark, texts, ids=None, source="s", clash=True):
    """Documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    n = CLASH.count(",") + 1
    rows = [(i, t, "en", source, len(t or ""), *["x"] * (n * clash)) for i, t in zip(ids, texts, strict=True)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame(rows, f"{schema}, {CLASH}" if clash else schema)


def hostile(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, a null id."""
    texts = [None, "", " \n\t", WORDS, WORDS, WORDS + " x", LONG, "a", "é" * 300, "é" * 300, WORDS, "\x00[]<s>"]
    return documents(spark, texts, [0, 1, 2, 3, 3, 4, 5, 6, 7, 8, None, 9])


def rows(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
