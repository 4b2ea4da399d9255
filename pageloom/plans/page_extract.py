"""Everything about a page: the 34-column summary and its child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import forms, stats
from pageloom.functions import markup as M
from pageloom.functions import text as X
from pageloom.operators import directory, elements

# Columns an item brings along; a plain page table lacks them and reads NULL.
ITEM_COLUMNS = {
    "title": "string",
    "slug": "string",
    "status": "string",
    "type": "string",
    "date": "timestamp",
    "modified": "timestamp",
    "author": "bigint",
}


#: Letters of a preview.
PREVIEW = 1000


def _with_item_columns(pages: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(kind) for c, kind in ITEM_COLUMNS.items() if c not in pages.columns}
    if "slug" in missing:
        missing["slug"] = X.slug(F.col("url"))
    return pages.withColumns(missing) if missing else pages


# What else is read off the HTML itself.
_FIGURES = {
    "paragraph_count": lambda html: M.paragraph_count(html),
    "image_count": lambda html: F.size(M.open_tags(html, M.IMAGE)),
    "form_count": lambda html: M.form_count(html),
    "html_preview": lambda html: X.preview(html, PREVIEW),
}


def _figure(pages: DataFrame, name: str) -> Column:
    """The stored column of parsed pages, else read off the HTML."""
    return F.col(name) if name in pages.columns else _FIGURES[name](F.col("html")).alias(name)


def page_metrics(pages: DataFrame) -> DataFrame:
    """Words, characters, paragraphs, headings, links and images of each page."""
    return _read(pages.withColumn("html", F.coalesce("html", F.lit("")))).select("page_id", *_metric_columns())


def _read(pages: DataFrame, *keep: Column | str) -> DataFrame:
    """What the metrics are computed from, next to the columns to keep."""
    html = F.col("html")
    return pages.select(
        "page_id",
        *keep,
        (F.col("text") if "text" in pages.columns else directory.readable_text(html)).alias("text"),
        elements.array_of(pages, "headings").alias("headings"),
        elements.array_of(pages, "links").alias("links"),
        _figure(pages, "paragraph_count"),
        _figure(pages, "image_count"),
    )


def _metric_columns() -> list[Column]:
    return [
        X.word_count(F.col("text")).alias("word_count"),
        F.length("text").alias("character_count"),
        F.col("paragraph_count"),
        F.size(F.filter("headings", lambda h: h["text"] != "")).alias("heading_count"),
        F.size(F.filter("links", lambda k: (k["url"] != "") & (k["text"] != ""))).alias("link_count"),
        F.col("image_count"),
    ]


def page_summary(pages: DataFrame, start_marker: str | None = None) -> DataFrame:
    """One wide row per page. All figures come from the page's own row, its businesses too (directory.with_listings)."""
    known = "businesses" in pages.columns
    head = elements.with_heads(_with_item_columns(pages))
    read = _read(
        head,
        *("url", "head", *ITEM_COLUMNS),
        "businesses" if known else "html",
        elements.array_of(head, "tags").alias("tags"),
        F.size(elements.array_of(head, "json_ld")).alias("schema_markup_count"),
        elements.array_of(head, "images").alias("images"),
        elements.array_of(head, "media").alias("media"),
        _figure(pages, "form_count"),
    )
    text = F.col("text")
    values = lambda found: F.transform(found, lambda v: v["value"])
    of_kind = lambda kind: F.size(F.filter("media", lambda m: m["kind"] == kind))
    seo = [c for c in elements.seo_tag_columns(F.col("head"), F.col("tags"))][:-1]
    summary = read.select(
        "page_id",
        "title",
        "url",
        "slug",
        "status",
        "type",
        F.col("date").alias("date_published"),
        F.col("modified").alias("date_modified"),
        F.col("author").alias("author_id"),
        *_metric_columns(),
        *seo,
        "schema_markup_count",
        F.array_join(values(M.page_phones(text)), "; ").alias("phone_numbers"),
        F.array_join(M.emails(text), "; ").alias("email_addresses"),
        F.array_join(values(M.page_addresses(text)), "; ").alias("addresses"),
        F.array_join(M.social(text), "; ").alias("social_links"),
        F.size(F.filter("images", lambda i: i["src"] != "")).alias("total_images"),
        of_kind("video").alias("total_videos"),
        of_kind("audio").alias("total_audio"),
        "form_count",
        *(["businesses"] if known else ["html", "text"]),
    )
    # Last, for all that is selected from the listings' long expressions is analyzed with them.
    listed = summary if known else directory.with_listings(summary, start_marker)
    shown = [c for c in summary.columns if c not in ("html", "text", "businesses")]
    counted = F.coalesce(F.size("businesses"), F.lit(0)).cast("bigint").alias("business_listings")
    return listed.select(*shown, counted, F.current_timestamp().alias("extracted_at"))


def page_extract(
    pages: DataFrame, start_marker: str | None = None, store: str | None = None
) -> dict[str, DataFrame]:
    """All tables of an extraction by name; without a store none is computed until it is written.

    Eleven tables would parse the HTML eleven times. With a store path in a folder all executors share, one job reads the
    HTML and writes what is in it there, without the HTML: element arrays, businesses, figures. The tables read that back,
    each its own columns.
    """
    ready = directory.with_listings(elements.parsed(pages).withColumn("text", directory.readable_text(F.col("html"))), start_marker)
    if store is not None:
        figures = {name: _figure(ready, name) for name in _FIGURES}
        as_text = F.transform("json_ld", lambda v: F.to_json(v))  # files of this kind hold no variants
        ready.withColumns({**figures, "json_ld": as_text}).drop("html").write.mode("overwrite").parquet(f"{store}/pages")
        ready = pages.sparkSession.read.parquet(f"{store}/pages")
        ready = ready.withColumn("json_ld", F.transform("json_ld", lambda text: F.parse_json(text)))
    media = elements.media(ready)
    return {
        "page_summary": page_summary(ready),
        "headings": elements.filled_headings(ready),
        "links": elements.listed_links(ready),
        "images": media.where(F.col("kind") == "image"),
        "media": media,
        "forms": elements.forms(ready),
        "seo_tags": elements.seo_tags(ready),
        "schema_markup": elements.schema_markup(ready),
        "contacts": elements.page_contacts(ready.select("page_id", "text")),
        "business_data": directory.page_businesses(ready),
        "previews": previews(ready),
    }


def previews(pages: DataFrame) -> DataFrame:
    """The first characters of each page's HTML and text."""
    text = F.col("text") if "text" in pages.columns else directory.readable_text(F.col("html"))
    read = pages.select("page_id", _figure(pages, "html_preview").alias("html"), forms.drop_marker_noise(text).alias("text"))
    return read.select("page_id", "html", X.preview(F.col("text"), PREVIEW).alias("text"))
