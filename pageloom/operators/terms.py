"""Tokens, phrases and the most frequent terms of each text.

Frequencies are taken inside the row: terms are sorted with their positions, runs of equal terms are
counted, and the counts sorted again. A text's terms never leave its row, so the job needs no shuffle,
while exploding and grouping would move about as many bytes as the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import stats
from pageloom.functions import text as X
from pageloom.functions.rows import exploded


def tokens(texts: DataFrame) -> DataFrame:
    """One row per word token with its position."""
    keys = [c for c in texts.columns if c != "text"]
    return exploded(texts, X.word_tokens(F.col("text")), *keys).withColumnRenamed("e", "token")


def sentences(texts: DataFrame) -> DataFrame:
    """Pieces between sentence ends; blank ones are kept and flagged."""
    keys = [c for c in texts.columns if c != "text"]
    pieces = F.split(F.col("text"), "[.!?]+", -1)
    rows = exploded(texts, pieces, *keys).withColumnRenamed("e", "sentence")
    return rows.withColumn("is_blank", X.blank(F.col("sentence")))


def _counted(rows: DataFrame, keys: list[str], lists: dict[str, Column]) -> DataFrame:
    """Replace term lists by their frequency lists.

    Each step is a select of its own that reads its inputs more than once, which keeps the optimizer from
    folding a list into the lambda that indexes it.
    """
    rows = rows.select(*keys, *[stats.located(c).alias(name) for name, c in lists.items()])
    rows = rows.select("*", *[stats.run_starts(F.col(name)).alias(f"{name}_starts") for name in lists])
    return rows.select(
        *keys,
        *[F.size(name).alias(f"{name}_total") for name in lists],
        *[stats.frequencies(F.col(name), F.col(f"{name}_starts")).alias(name) for name in lists],
    )


def _ranked(rows: DataFrame, keys: list[str], name: str, kind: str, k: int | None) -> DataFrame:
    top = F.col(name) if k is None else F.slice(F.col(name), 1, k)
    total = F.col(f"{name}_total")
    return exploded(rows, top, *keys, total.alias("total")).select(
        *keys,
        F.lit(kind).alias("kind"),
        (F.col("pos") + 1).alias("rank"),
        F.col("e.term").alias("term"),
        (-F.col("e.less")).alias("n"),
        "total",
    )


def top_keywords(texts: DataFrame, k: int | None = 20) -> DataFrame:
    """Most frequent meaningful tokens with their share of all meaningful tokens in percent."""
    keys = [c for c in texts.columns if c != "text"]
    rows = _counted(texts, keys, {"kw": stats.keywords(X.word_tokens(F.col("text")))})
    share = F.round(F.col("n") / F.col("total") * 100, 2)
    return _ranked(rows, keys, "kw", "keyword", k).withColumn("pct", share)


def top_phrases(texts: DataFrame, n: int, k: int | None) -> DataFrame:
    """Most frequent runs of n adjacent tokens without stop words."""
    keys = [c for c in texts.columns if c != "text"]
    rows = texts.select(*keys, X.word_tokens(F.col("text")).alias("tokens"))
    rows = _counted(rows, keys, {"g": stats.ngrams(F.col("tokens"), n)})
    return _ranked(rows, keys, "g", {2: "bigram", 3: "trigram"}.get(n, f"{n}-gram"), k)


def top_words(texts: DataFrame, k: int | None = 20) -> DataFrame:
    """Most frequent purely a-z words, stop words included."""
    keys = [c for c in texts.columns if c != "text"]
    rows = _counted(texts, keys, {"w": stats.plain_words(F.col("text"))})
    return _ranked(rows, keys, "w", "word", k).drop("kind", "total")


def keyword_density(texts: DataFrame) -> DataFrame:
    """Top 20 keywords, 10 bigrams and 5 trigrams of each text from one pass over its tokens."""
    keys = [c for c in texts.columns if c != "text"]
    rows = texts.select(*keys, X.word_tokens(F.col("text")).alias("tokens"))
    token_list = F.col("tokens")
    rows = _counted(
        rows,
        keys,
        {
            "keyword": stats.keywords(token_list),
            "bigram": stats.ngrams(token_list, 2),
            "trigram": stats.ngrams(token_list, 3),
        },
    )
    def labelled(kind: str, k: int) -> Column:
        return F.transform(
            F.slice(F.col(kind), 1, k),
            lambda t, i: F.struct(
                F.lit(kind).alias("kind"),
                (i + 1).alias("rank"),
                t["term"].alias("term"),
                (-t["less"]).alias("n"),
            ),
        )

    tops = F.flatten(F.array(labelled("keyword", 20), labelled("bigram", 10), labelled("trigram", 5)))
    return exploded(rows, tops, *keys, F.col("keyword_total").alias("total_words")).select(
        *keys, "total_words", "e.kind", "e.rank", "e.term", "e.n"
    )
