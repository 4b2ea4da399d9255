"""Site rollups of the text corpus, insights, and the combined figures of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import fixed
from pageloom.functions.rows import exploded
from pageloom.operators import elements, texts as text_jobs
from pageloom.operators.audit import messages


def site_contacts(texts: DataFrame) -> DataFrame:
    """Distinct phones, e-mails and URLs of each site, one row per value.

    Rows, not one set per site: a site's contacts may be more than a task can hold.
    """
    return elements.corpus_contacts(texts.select("site", "text")).select("site", "kind", "value").distinct()


def category_counts(texts: DataFrame) -> DataFrame:
    return texts.groupBy("site", "category").agg(F.count("*").alias("files"))


def site_content(texts: DataFrame) -> DataFrame:
    """Totals of each site over texts(site, category, text), with its distinct contacts counted.

    An empty text counts as a file but has no part in the averages. Figures and contacts travel through
    one scan: each text yields an entry without a contact that carries its figures, and an entry per
    contact. Grouping by (site, kind, value) removes repeats before anything is counted per site, and a
    large site's figures arrive there as one sum per task.
    """
    measured = text_jobs.measured(texts.select("site", "category", "text", F.col("text").alias("_text")))
    filled = F.col("has_text")
    no_contact = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value")))
    entries = exploded(
        measured,
        F.concat(no_contact, elements.corpus_contact_array(F.coalesce("_text", F.lit("")))),
        "site",
        (F.col("category") == "pages").alias("is_page"),
        "has_text",
        "word_count",
        "character_count",
        "readability_score",
    )
    kind = F.col("e.kind")
    figure = F.col("pos") == 0
    distinct = entries.groupBy("site", kind.alias("kind"), F.col("e.value").alias("value")).agg(
        F.count_if(figure).alias("files"),
        F.count_if(figure & F.col("is_page")).alias("page_files"),
        F.count_if(figure & filled).alias("filled"),
        F.sum(F.when(figure & filled, F.col("word_count"))).alias("words"),
        F.sum(F.when(figure & filled, F.col("character_count"))).alias("characters"),
        F.sum(F.when(figure & filled, F.col("readability_score"))).alias("readability"),
    )
    total = F.sum("filled")
    return distinct.groupBy("site").agg(
        F.sum("files").alias("total_files"),
        F.sum("page_files").alias("page_files"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"),
        F.coalesce(F.sum("characters"), F.lit(0)).alias("total_characters"),
        F.when(total > 0, F.round(F.sum("readability") / total, 2)).alias("avg_readability"),
        *[F.count_if(F.col("kind") == kind).alias(f"{kind}_count") for kind in ("phone", "email", "url")],
    )


def _insights() -> Column:
    words, ease = F.col("total_words"), F.col("avg_readability")

    def note(condition: Column, code: str, figure: Column) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("code"), figure.cast("string").alias("detail")))

    shown = F.format_number(words, 0)
    return F.array_compact(
        F.array(
            note(words > 10000, "large_content", shown),
            note((words > 5000) & (words <= 10000), "medium_content", shown),
            note(words <= 5000, "compact_content", shown),
            note(ease >= 80, "very_readable", ease),
            note((ease >= 60) & (ease < 80), "fairly_readable", ease),
            note(ease < 60, "complex", ease),
            note(F.col("phone_count") > 5, "many_phones", F.col("phone_count")),
            note(F.col("email_count") > 3, "many_emails", F.col("email_count")),
            note(F.col("url_count") > 20, "many_urls", F.col("url_count")),
            note(F.col("page_files") > 10, "many_pages", F.col("page_files")),
        )
    )


def site_insights(content: DataFrame) -> DataFrame:
    """Remarks on each site, one row per remark; sites without text get none."""
    with_text = content.where(F.col("avg_readability").isNotNull())
    noted = with_text.select("site", _insights().alias("notes"))
    return exploded(noted, "notes", "site").select(
        "site",
        "pos",
        F.col("e.code").alias("code"),
        F.col("e.detail").alias("detail"),
        F.get(messages(F.array("e"), fixed.INSIGHTS), F.lit(0)).alias("message"),
    )


def combined(content: DataFrame, scores: DataFrame) -> DataFrame:
    """Content and audit figures of each site side by side; a site may have only one of them."""
    joined = content.select("site", "total_words", "total_files", "phone_count").join(
        scores.select("site", "avg_seo_score", "total_pages"), "site", "full"
    )
    return joined.select(
        "site",
        F.coalesce("total_words", F.lit(0)).alias("total_words"),
        F.coalesce("avg_seo_score", F.lit(0.0)).alias("avg_seo_score"),
        F.coalesce("total_files", F.lit(0)).alias("total_files"),
        F.coalesce("phone_count", F.lit(0)).alias("phone_count"),
        F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
    )
