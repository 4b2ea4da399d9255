"""Site reports: audit summary, content summary, and both side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.functions import text as X
from pageloom.functions.rows import exploded
from pageloom.operators import audit, elements, rollups


def site_audit(pages: DataFrame) -> dict[str, DataFrame]:
    """Tables of the audit report. Write 'pages' once and build the rest from it where pages are many."""
    page_audit = audit.page_audit(pages)
    return {
        "pages": audit.readable_audit(page_audit),
        "scores": audit.site_scores(page_audit),
        "top_issues": audit.top_notes(page_audit, "issues"),
        "top_recommendations": audit.top_notes(page_audit, "recommendations"),
        "bands": audit.score_bands(page_audit),
        "page_bands": audit.page_bands(page_audit),
        "first_pages": audit.first_pages(page_audit),
    }


def site_issue_report(pages: DataFrame, k: int = 5) -> DataFrame:
    """Mean score and the most frequent issues of each site, in one pass over the pages.

    Score sums and issue counts are grouped together, so the audit runs once and only a few rows per
    site and task are shuffled.
    """
    page_audit = audit.page_audit(pages).select("site", "seo_score", F.col("issues")["code"].alias("codes"))
    # One extra entry per page carries the score; the others carry an issue each.
    entries = F.concat(F.array(F.lit(None).cast("string")), F.col("codes"))
    counted = (
        exploded(page_audit, entries, "site", "seo_score")
        .groupBy("site", F.col("e").alias("code"))
        .agg(F.count("*").alias("pages"), F.sum("seo_score").alias("points"))
    )
    issues = F.filter(F.collect_list(F.struct((-F.col("pages")).alias("less"), "code")), lambda e: e["code"].isNotNull())
    # A site has at most as many entries as there are codes.
    sites = counted.groupBy("site").agg(
        F.max(F.when(F.col("code").isNull(), F.col("pages"))).alias("total_pages"),
        F.max(F.when(F.col("code").isNull(), F.col("points"))).alias("points"),
        F.slice(F.sort_array(issues), 1, k).alias("top"),
    )
    return sites.select(
        "site",
        "total_pages",
        F.round(F.col("points") / F.col("total_pages"), 1).alias("avg_seo_score"),
        F.posexplode_outer("top").alias("at", "e"),
    ).select(
        "site",
        "total_pages",
        "avg_seo_score",
        (F.col("at") + 1).alias("issue_rank"),
        F.col("e.code").alias("issue"),
        (-F.col("e.less")).alias("issue_pages"),
    )


def site_content_report(texts: DataFrame) -> dict[str, DataFrame]:
    """Tables of the content report over texts(site, category, text)."""
    content = rollups.site_content(texts)
    return {
        "summary": content,
        "categories": rollups.category_counts(texts),
        "contacts": rollups.site_contacts(texts),
        "insights": rollups.site_insights(content),
    }


def site_overview(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """Content and audit figures of each site side by side."""
    return rollups.combined(rollups.site_content(texts), audit.site_scores(audit.page_audit(pages)))


def page_overview(pages: DataFrame) -> DataFrame:
    """site_overview of pages whose visible texts are the corpus: one scan, and each page's text is decoded once.

    A page gives an entry with its figures and one per phone; grouping by site and phone removes repeats, and a large
    site's figures arrive as one sum per task.
    """
    read = audit.page_audit(pages, with_text=True).select("site", "seo_score", "visible_text")
    phones = M.corpus_phones(F.col("visible_text"))
    entries = exploded(
        read,
        F.concat(F.array(F.lit(None).cast("string")), F.coalesce(phones, F.array().cast("array<string>"))),
        "site",
        "seo_score",
        X.word_count(F.col("visible_text")).alias("words"),
    )
    figure = F.col("pos") == 0
    distinct = entries.groupBy("site", F.col("e").alias("phone")).agg(
        F.count_if(figure).alias("pages"),
        F.sum(F.when(figure, F.col("words"))).alias("words"),
        F.sum(F.when(figure, F.col("seo_score"))).alias("points"),
    )
    return distinct.groupBy("site").agg(
        F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"),
        F.round(F.sum("points") / F.sum("pages"), 1).alias("avg_seo_score"),
        F.sum("pages").alias("total_files"),
        F.count("phone").alias("phone_count"),
        F.sum("pages").alias("total_pages"),
    )


def audited_texts(pages: DataFrame) -> DataFrame:
    """Visible texts of pages as a corpus (site, category, text)."""
    return pages.select(
        X.site_key(F.col("url")).alias("site"), F.lit("pages").alias("category"), X.visible_text(F.col("html")).alias("text")
    )


def external_domains(pages: DataFrame) -> DataFrame:
    """How often each site links to each foreign domain."""
    return elements.external_links(pages).groupBy("site", "domain").agg(F.count("*").alias("links"))
