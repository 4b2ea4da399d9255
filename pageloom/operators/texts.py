"""Text jobs: the stored text forms of items and the per-text statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import fixed, forms, stats
from pageloom.functions import text as X
from pageloom.functions.rows import exploded
from pageloom.operators import directory


def _empty() -> Column:
    return F.lit("")


def items_clean(items: DataFrame) -> DataFrame:
    """Nested items as flat rows; items without title and body are left out."""
    flat = items.select(
        "site",
        "rest_base",
        "id",
        F.coalesce(F.nullif(F.col("slug"), _empty()), F.col("id").cast("string")).alias("slug"),
        X.strip(F.coalesce(F.col("title.rendered"), _empty())).alias("title"),
        F.coalesce(F.col("content.rendered"), _empty()).alias("html"),
        F.coalesce(F.col("excerpt.rendered"), _empty()).alias("excerpt"),
        F.coalesce(F.col("link"), _empty()).alias("url"),
        F.coalesce(F.col("status"), _empty()).alias("status"),
        F.coalesce(F.col("type"), _empty()).alias("type"),
        "date",
        "modified",
        "author",
        "yoast_head",
        "rankmath_head",
    )
    return flat.where(~(X.blank(F.col("title")) & X.blank(F.col("html"))))


def _with_map_listing(pages: DataFrame) -> DataFrame:
    """pages with '_listed': the businesses of a page's map with what the page says about them, NULL without a map."""
    html = F.col("html")
    mapped = html.contains("map_markers=")
    read = directory.with_markers(pages, "_markers", "_near", mapped)
    detailed = read.withColumn("_listed", directory.detail_array(F.col("_markers"), F.col("_near"))).drop("_markers", "_near")
    return detailed.withColumn("_listed", directory.listing_entries(F.col("_listed")))


def page_text(pages: DataFrame, businesses: Column | None = None) -> DataFrame:
    """The text forms of each page: raw, readable, directory and markdown. One scan, no shuffle.

    The businesses of the page's map close the directory text and the markdown as JSON; businesses names an array column
    to write in their place. The JSON stands in the markdown as it is, for its lines are no lines of the page.
    """
    title = F.col("title") if "title" in pages.columns else F.lit("")
    keys = [c for c in pages.columns if c not in ("html",)]
    html = F.col("html")
    listed = _with_map_listing(pages) if businesses is None else pages.withColumn("_listed", businesses)
    rows = listed.select(*keys, "_listed", forms.raw_text(html).alias("_raw"), forms.link_text(html).alias("text"))
    blocks = {"_pretty": forms.directory_text(F.col("text")), "_block": forms.listing_block(F.col("_listed"))}
    return rows.withColumns(blocks).select(
        *keys,
        forms.with_title(title, F.col("_raw")).alias("raw_text"),
        "text",
        forms.with_title(title, F.concat("_pretty", "_block")).alias("pretty_text"),
        F.concat(forms.markdown(F.col("_pretty"), title, F.col("url")), "_block").alias("markdown"),
    )


def shortcode_counts(texts: DataFrame) -> DataFrame:
    """Texts without page-builder shortcodes, and how many of each family went."""
    keys = [c for c in texts.columns if c != "text"]
    return texts.select(
        *keys,
        forms.drop_shortcodes(F.col("text")).alias("text"),
        *[stats.count_of(F.col("text"), p).alias(f"{family}_count") for family, p in fixed.SHORTCODES.items()],
    )


def markdown_lines(texts: DataFrame) -> DataFrame:
    """Lines of each text with their class and decorated form."""
    keys = [c for c in texts.columns if c != "text"]
    lines = exploded(texts, forms.text_lines(F.col("text")), *keys).withColumnsRenamed({"pos": "line_no", "e": "line"})
    kind, line = F.col("line_class"), F.col("line")
    return lines.select(*keys, "line_no", "line", forms.line_class(line).alias("line_class")).select(
        *keys,
        "line_no",
        "line_class",
        F.when(kind == "heading", F.concat(F.lit("## "), line))
        .when(kind == "text", forms.markdown_line(line))
        .otherwise("")
        .alias("md"),
    )


def measured(texts: DataFrame) -> DataFrame:
    """Size and readability of each text. One scan, no shuffle; empty texts measure 0.

    The average sentence length divides by all pieces between sentence ends, empty ones included.
    """
    text = F.col("text")
    keys = [c for c in texts.columns if c != "text"]
    counted = texts.select(
        *keys,
        (F.coalesce(text, _empty()) != "").alias("has_text"),
        X.word_count(text).alias("word_count"),
        F.length(text).alias("character_count"),
        stats.line_count(text).alias("line_count"),
        stats.sentence_pieces(text).alias("sentence_count"),
        _sentence_words(text).alias("_in_sentences"),
        stats.spaced_syllables(text).alias("_syllables"),
    )
    ease = stats.reading_ease(F.col("word_count"), F.col("sentence_count"), F.col("_syllables"))
    return counted.select(
        *keys,
        "has_text",
        "word_count",
        "character_count",
        "line_count",
        "sentence_count",
        F.round(F.col("_in_sentences") / F.col("sentence_count"), 2).alias("avg_sentence_length"),
        ease.alias("readability_score"),
    )


def text_stats(texts: DataFrame) -> DataFrame:
    """Figures of each non-empty text; an empty text has none."""
    figures = measured(texts)
    kept = [c for c in figures.columns if c != "has_text"]
    # An array of one or no row, because a filter would move down and compute a derived text twice.
    return exploded(figures, F.when(F.col("has_text"), F.array(F.struct(*kept)))).select("e.*")


def _sentence_words(text: Column) -> Column:
    """Whitespace-separated words counted after cutting at sentence ends."""
    return stats.count_of(text, r"(?U)[^\s.!?]+")
