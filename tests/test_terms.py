from __future__ import annotations

import random
import re
from collections import Counter

from conftest import rows

from pageloom.functions.fixed import STOP_WORDS
from pageloom.operators import terms, texts as text_jobs


def test_ties_go_to_the_first_seen(texts):
    df = terms.top_words(texts("b a b a c"), 2)
    assert rows(df, "rank", "term", "n") == [(1, "b", 2), (2, "a", 2)]


def test_bigrams_skip_stop_words_but_not_over_them(texts):
    df = terms.top_phrases(texts("red big the red big"), 2, 10)
    assert rows(df, "term", "n") == [("red big", 2)]


def test_empty_and_short_texts(texts):
    df = texts("", None, "x", "the")
    assert terms.top_keywords(df).count() == 0
    assert terms.top_phrases(df, 3, 5).count() == 0
    assert rows(terms.top_words(df), "page_id", "term") == [(3, "x"), (4, "the")]


def test_frequencies_equal_a_counter(texts):
    rng = random.Random(5)
    vocabulary = ["the", "of", "dock", "lift", "boat", "ab", "año", "x_1", "sea"]
    samples = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)]
    got: dict = {}
    for r in terms.keyword_density(texts(*samples)).collect():
        got.setdefault((r.page_id, r.kind), []).append((r.rank, r.term, r.n, r.total_words))
    for i, sample in enumerate(samples, 1):
        tokens = re.findall(r"\w+", sample.lower())
        kept = [t for t in tokens if t not in STOP_WORDS and len(t) > 2]
        want = {"keyword": (kept, 20)}
        for n, kind, k in ((2, "bigram", 10), (3, "trigram", 5)):
            runs = [tokens[j : j + n] for j in range(len(tokens) - n + 1)]
            want[kind] = ([" ".join(run) for run in runs if not set(run) & set(STOP_WORDS)], k)
        for kind, (items, k) in want.items():
            expected = [(rank, t, n, len(kept)) for rank, (t, n) in enumerate(Counter(items).most_common(k), 1)]
            assert sorted(got.get((i, kind), [])) == expected


def test_shares_and_counts_add_up(texts):
    df = terms.top_keywords(texts("dock dock lift sea"), None)
    assert rows(df, "term", "n", "total", "pct") == [("dock", 2, 4, 50.0), ("lift", 1, 4, 25.0), ("sea", 1, 4, 25.0)]


def test_partitioning_does_not_matter(texts):
    df = texts(*[f"a b c{i % 3} a dock" for i in range(20)])
    one, many = (rows(terms.keyword_density(df.repartition(n))) for n in (1, 7))
    assert one == many


def test_tokens_and_sentences(texts):
    df = texts("One. Two!! ")
    assert rows(terms.tokens(df), "pos", "token") == [(0, "one"), (1, "two")]
    assert rows(terms.sentences(df), "pos", "sentence", "is_blank") == [(0, "One", False), (1, " Two", False), (2, " ", True)]


def test_text_stats(texts):
    df = text_jobs.text_stats(texts("", "a b. c"))
    row = df.first()
    assert df.count() == 1
    assert (row.word_count, row.character_count, row.sentence_count, row.avg_sentence_length) == (3, 6, 2, 1.5)
    assert 0 <= row.readability_score <= 100


def test_blank_text_reads_zero(texts):
    row = text_jobs.text_stats(texts("  \n ")).first()
    assert (row.word_count, row.readability_score) == (0, 0.0)


def test_shortcode_counts(texts):
    row = text_jobs.shortcode_counts(texts("[vc_row]a[/vc_row][divider][nectar_x]")).first()
    assert (row.text, row.visual_composer_count, row.divider_count, row.nectar_count) == ("a", 2, 1, 1)


def test_page_text_with_title_and_businesses(pages):
    from pyspark.sql import functions as F

    from pageloom.operators import directory

    df = pages('<p>Hello there.</p>[nectar_gmap map_markers="45.1 | -94.2 | Acme"]').withColumn("title", F.lit(" T "))
    row = text_jobs.page_text(df, directory.marker_array(F.col("html"))).first()
    assert row.raw_text.startswith("T\n\nHello there.")
    assert '"name":"Acme"' in row.pretty_text and row.pretty_text.startswith("T\n\nHello there.")
    assert row.markdown.startswith("# T\n\n**Source:**")
