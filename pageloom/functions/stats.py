"""Per-text figures as single expressions: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import fixed
from pageloom.functions.text import every, let

VOWELS = "[aeiouy]+"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_count(text: Column) -> Column:
    """Lines of a text; a closing line break opens no new line."""
    body = F.regexp_replace(text, r"\R\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(body, r"\R", -1)))


def sentence_pieces(text: Column) -> Column:
    """Pieces between sentence ends, the empty ones included."""
    return F.size(F.split(text, "[.!?]+", -1))


def filled_sentences(text: Column) -> Column:
    """Pieces between sentence ends that hold more than white space."""
    return count_of(text, r"(?U)[^\s.!?][^.!?]*")


def _syllables(text: Column, between: str) -> Column:
    """Vowel runs of all words, less a silent final e, and at least one for each word.

    between matches what parts two words. It becomes two spaces, one for each neighbour, so that plain
    character classes find the words; possessive runs keep the patterns linear in a word's length.
    """
    silent = " [^ aeiouy]*+[aeiouy]++[^ aeiouy][^ ]*e "
    toneless = " [^ aeiouy]++ "

    def counted(spaced: Column) -> Column:
        return count_of(spaced, VOWELS) - count_of(spaced, silent) + count_of(spaced, toneless)

    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), between, "  "), F.lit(" "))
    return let(spaced, counted)


def spaced_syllables(text: Column) -> Column:
    """Syllables of the whitespace-separated words."""
    return _syllables(text, r"(?U)\s+")


def token_syllables(text: Column) -> Column:
    """Syllables of the word tokens."""
    return _syllables(text, r"[^\p{L}\p{N}_]+")


def reading_ease(words: Column, sentences: Column, syllables: Column) -> Column:
    """Flesch reading ease held between 0 and 100; 0 where there is nothing to read."""
    per_sentence = words.cast("double") / sentences
    per_word = syllables.cast("double") / words
    score = F.lit(206.835) - (F.lit(1.015) * per_sentence) - (F.lit(84.6) * per_word)
    return F.when(
        (words > 0) & (sentences > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    ).otherwise(0.0)


def grade(score: Column, readable: Column) -> Column:
    ladder = F.when(~readable, "Unknown")
    for floor, name in fixed.GRADES:
        ladder = ladder.when(score >= floor, name)
    return ladder.otherwise(fixed.LOWEST_GRADE)


# --- frequencies ------------------------------------------------------------------------------


def not_stop(token: Column) -> Column:
    return ~token.isin(*fixed.STOP_WORDS)


def keywords(tokens: Column) -> Column:
    """Tokens that carry meaning: longer than two letters and no stop word."""
    return F.filter(tokens, lambda t: (F.length(t) > 2) & not_stop(t))


def plain_words(text: Column) -> Column:
    """Lower-cased tokens made of the letters a to z only."""
    return every(F.lower(text), r"(?<![\p{L}\p{N}_])[a-z]++(?![\p{L}\p{N}_])")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n adjacent tokens free of stop words.

    A stop word becomes NULL, and so does every run over one or over the end.
    """

    def runs(marked: Column) -> Column:
        def run(token: Column, i: Column) -> Column:
            return F.concat(token, *[part for k in range(1, n) for part in (F.lit(" "), F.get(marked, i + k))])

        return F.array_compact(F.transform(marked, run))

    return let(F.transform(tokens, lambda t: F.when(not_stop(t), t)), runs)


def located(terms: Column) -> Column:
    """Terms with their positions, sorted, so that equal terms lie side by side."""
    return F.sort_array(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))


def run_starts(ordered: Column) -> Column:
    """Indexes where a new term begins in a sorted list."""
    last = F.size(ordered) - 1
    indexes = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(
        indexes,
        lambda j: (j == 0) | (F.get(ordered, j)["term"] != F.get(ordered, j - 1)["term"]),
    )


def frequencies(ordered: Column, starts: Column) -> Column:
    """One struct per distinct term, most frequent first, ties by first appearance."""

    def end(k: Column) -> Column:
        return F.coalesce(F.get(starts, k + 1), F.size(ordered))

    return F.sort_array(
        F.transform(
            starts,
            lambda start, k: F.struct(
                (start - end(k)).alias("less"),
                F.get(ordered, start)["pos"].alias("pos"),
                F.get(ordered, start)["term"].alias("term"),
            ),
        )
    )
