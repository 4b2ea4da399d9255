"""The page audit: facts, a score out of 100, issues and recommendations.

Everything a page's audit needs stands in the page's own row, so the audit is one scan without a shuffle;
only the site rollups group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions import fixed, stats
from pageloom.functions import markup as M
from pageloom.functions import text as X
from pageloom.functions.rows import exploded


def page_facts(pages: DataFrame, with_text: bool = False) -> DataFrame:
    """What the audit measures on each page; with_text adds the visible text that it was measured on."""
    pages = pages.withColumn("html", F.coalesce("html", F.lit("")))
    html, url = F.col("html"), F.col("url")
    pictures = M.open_tags(html, M.IMAGE)
    read = pages.select(
        "page_id",
        X.site_key(url).alias("site"),
        "url",
        X.authority(url).alias("_domain"),
        X.decode_all(
            M.title(html), F.coalesce(M.meta(M.metas(html), "description"), F.lit("")), X.drop_page_tags(html)
        ).alias("_texts"),
        M.heading_levels(html).alias("_levels"),
        M.link_urls(html).alias("_urls"),
        F.transform(pictures, lambda t: M.attribute(t, "alt").isNotNull()).alias("_alts"),
    )
    title, description, visible = (F.get("_texts", F.lit(i)) for i in range(3))

    def links_of(scope: str) -> Column:
        return F.size(F.filter("_urls", lambda u: M.link_scope(u, F.col("url"), F.col("_domain")) == scope))

    counted = read.select(
        "page_id",
        "site",
        "url",
        title.alias("title"),
        F.length(title).alias("title_length"),
        X.word_count(title).alias("title_words"),
        description.alias("description"),
        F.length(description).alias("description_length"),
        F.get("_levels", F.lit(0)).alias("h1_count"),
        F.aggregate("_levels", F.lit(0), lambda a, n: a + n).alias("total_headings"),
        M.hierarchy_ok(F.col("_levels")).alias("has_proper_hierarchy"),
        *([visible.alias("visible_text")] if with_text else []),
        stats.count_of(visible, X.WORD).alias("_words"),
        # Lower-casing changes the words only where it changes the length.
        F.when(
            F.length(F.lower(visible)) != F.length(visible), stats.count_of(F.lower(visible), X.WORD)
        ).alias("_lower_words"),
        stats.filled_sentences(visible).alias("_sentences"),
        stats.token_syllables(visible).alias("_syllables"),
        links_of("internal").alias("internal_links"),
        links_of("external").alias("external_links"),
        F.size("_alts").alias("total_images"),
        F.size(F.filter("_alts", lambda a: a)).alias("images_with_alt"),
    )
    words, sentences = F.col("_words"), F.col("_sentences")
    scored = counted.withColumns(
        {
            "_ease": stats.reading_ease(words, sentences, F.col("_syllables")),
            "word_count": F.coalesce("_lower_words", "_words"),
        }
    )
    readable = (words > 0) & (sentences > 0)
    return scored.select(
        *[c for c in scored.columns if not c.startswith("_")],
        (F.col("total_images") - F.col("images_with_alt")).alias("images_without_alt"),
        F.round("_ease", 1).alias("flesch_score"),
        stats.grade(F.col("_ease"), readable).alias("grade_level"),
        F.when(readable, F.round(words / sentences, 1)).alias("avg_sentence_length"),
        F.when(readable, F.round(F.col("_syllables") / words, 1)).alias("avg_syllables_per_word"),
    )


# One condition ladder per scored figure; the score of a page is their sum, at most 100.
POINTS = {
    "title_length_points": "CASE WHEN title_length BETWEEN 30 AND 60 THEN 15 ELSE 0 END",
    "title_words_points": "CASE WHEN title_words >= 3 THEN 5 ELSE 0 END",
    "description_points": "CASE WHEN description_length BETWEEN 120 AND 160 THEN 15 ELSE 0 END",
    "h1_points": "CASE WHEN h1_count = 1 THEN 10 ELSE 0 END",
    "hierarchy_points": "CASE WHEN has_proper_hierarchy THEN 10 ELSE 0 END",
    "content_points": "CASE WHEN word_count >= 300 THEN 15 WHEN word_count >= 150 THEN 10 ELSE 0 END",
    "image_points": "CASE WHEN total_images > 0 THEN CAST(images_with_alt / total_images * 10 AS INT) ELSE 0 END",
    "reading_points": "CASE WHEN flesch_score >= 60 THEN 10 WHEN flesch_score >= 30 THEN 5 ELSE 0 END",
    "internal_link_points": "CASE WHEN internal_links >= 3 THEN 5 ELSE 0 END",
    "external_link_points": "CASE WHEN external_links BETWEEN 1 AND 5 THEN 5 ELSE 0 END",
}

# When a page earns an issue or a recommendation, by code. The last part names the figure in its text.
_OFF_TITLE = "title <> '' AND title_length NOT BETWEEN 30 AND 60"
_OFF_DESCRIPTION = "description <> '' AND description_length NOT BETWEEN 120 AND 160"
ISSUE_RULES = (
    ("title_length", _OFF_TITLE, "title_length"),
    ("title_few_words", "title <> '' AND title_words < 3", None),
    ("title_missing", "title = ''", None),
    ("description_length", _OFF_DESCRIPTION, "description_length"),
    ("description_missing", "description = ''", None),
    ("h1_missing", "h1_count = 0", None),
    ("h1_multiple", "h1_count > 1", "h1_count"),
    ("hierarchy_poor", "NOT has_proper_hierarchy", None),
    ("content_short", "word_count < 150", "word_count"),
    ("alt_missing", "images_without_alt > 0", "images_without_alt"),
    ("hard_to_read", "flesch_score < 30", None),
)
ADVICE_RULES = (
    ("title_length", _OFF_TITLE, None),
    ("title_missing", "title = ''", None),
    ("description_length", _OFF_DESCRIPTION, None),
    ("description_missing", "description = ''", None),
    ("h1_missing", "h1_count = 0", None),
    ("h1_multiple", "h1_count > 1", None),
    ("hierarchy_poor", "NOT has_proper_hierarchy", None),
    ("content_medium", "word_count BETWEEN 150 AND 299", "word_count"),
    ("content_short", "word_count < 150", None),
    ("alt_missing", "images_without_alt > 0", None),
    ("fairly_hard_to_read", "flesch_score >= 30 AND flesch_score < 60", None),
    ("hard_to_read", "flesch_score < 30", None),
    ("few_internal_links", "internal_links < 3", None),
    ("many_external_links", "external_links > 5", None),
)


def _notes(rules: tuple[tuple[str, str, str | None], ...]) -> Column:
    """array<struct<code, detail>> of the rules a page meets."""
    notes = ", ".join(
        f"CASE WHEN {condition} THEN named_struct('code', '{code}', 'detail', CAST({figure or 'NULL'} AS INT)) END"
        for code, condition, figure in rules
    )
    return F.expr(f"array_compact(array({notes}))")


def page_audit(pages: DataFrame, with_text: bool = False) -> DataFrame:
    """Facts, sub-scores, score, issues and recommendations of each page; with_text as in page_facts."""
    scored = page_facts(pages, with_text).select("*", *[F.expr(rule).alias(name) for name, rule in POINTS.items()])
    return scored.select(
        "*",
        F.expr(f"least(100, {' + '.join(POINTS)})").alias("seo_score"),
        _notes(ISSUE_RULES).alias("issues"),
        _notes(ADVICE_RULES).alias("recommendations"),
    )


def messages(notes: Column, texts: dict[str, str]) -> Column:
    """Notes as readable sentences."""

    def sentence(note: Column) -> Column:
        chosen = None
        for code, text in texts.items():
            head, _, tail = text.partition("{0}")
            shown = F.concat(F.lit(head), note["detail"].cast("string"), F.lit(tail)) if "{0}" in text else F.lit(text)
            match = note["code"] == code
            chosen = F.when(match, shown) if chosen is None else chosen.when(match, shown)
        return chosen

    return F.transform(notes, sentence)


def readable_audit(audit: DataFrame) -> DataFrame:
    """The audit with its notes as sentences."""
    return audit.withColumns(
        {
            "issues": messages(F.col("issues"), fixed.ISSUES),
            "recommendations": messages(F.col("recommendations"), fixed.RECOMMENDATIONS),
        }
    )


def band(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").otherwise("poor")


def page_bands(audit: DataFrame) -> DataFrame:
    """Colour bands of each page's main figures."""
    good, warning, error = F.lit("good"), F.lit("warning"), F.lit("error")
    words = F.col("word_count")
    return audit.select(
        "page_id",
        "site",
        "seo_score",
        band(F.col("seo_score")).alias("score_band"),
        F.when(F.col("title_length").between(30, 60), good).otherwise(warning).alias("title_band"),
        F.when(F.col("description_length").between(120, 160), good).otherwise(warning).alias("description_band"),
        F.when(words >= 300, good).when(words >= 150, warning).otherwise(error).alias("word_band"),
        F.when(F.col("flesch_score") >= 60, good).otherwise(warning).alias("reading_band"),
        F.when(F.col("h1_count") == 1, good).otherwise(error).alias("h1_band"),
        F.when(F.col("images_without_alt") == 0, good).otherwise(warning).alias("image_band"),
    )


# --- sites ------------------------------------------------------------------------------------


def site_scores(audit: DataFrame) -> DataFrame:
    """Pages and mean score of each site."""
    return audit.groupBy("site").agg(
        F.count("*").alias("total_pages"), F.round(F.avg("seo_score"), 1).alias("avg_seo_score")
    )


def note_counts(audit: DataFrame, notes: str) -> DataFrame:
    """How many pages of a site show each issue or recommendation.

    A large site costs nothing extra: counts are formed before the shuffle.
    """
    return (
        exploded(audit, F.col(notes)["code"], "site")
        .groupBy("site", F.col("e").alias("code"))
        .agg(F.count("*").alias("pages"))
    )


def top_notes(audit: DataFrame, notes: str, k: int = 5) -> DataFrame:
    """The k most frequent notes of each site, ties by code."""
    order = W.partitionBy("site").orderBy(F.desc("pages"), "code")
    ranked = note_counts(audit, notes).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def score_bands(audit: DataFrame) -> DataFrame:
    return audit.groupBy("site", band(F.col("seo_score")).alias("band")).agg(F.count("*").alias("pages"))


def first_pages(audit: DataFrame, k: int = 10) -> DataFrame:
    """The first k pages of each site, as the report lists them."""
    order = W.partitionBy("site").orderBy("page_id")
    listed = audit.select("page_id", "site", "url", "title", "seo_score")
    return listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
