"""Named queries over the driver tables, one for each job of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import forms, stats
from pageloom.functions import text as X
from pageloom.operators import audit, directory, elements, rollups, terms, texts
from pageloom.plans import page_extract, samples, site_reports
from pageloom.sources import landed, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.pages(spark, sf_dir).select("page_id", X.visible_text(F.col("html")).alias("text"))



# --- pages: titles, tags, headings, links, media, forms ---------------------------------------


@query
def page_titles(spark, sf_dir):
    return elements.page_titles(samples.pages(spark, sf_dir), brand_words=("the", "lift"))


@query
def page_meta_tags(spark, sf_dir):
    return elements.seo_tags(samples.product_pages(spark, sf_dir)).drop("site")


@query
def page_meta_description(spark, sf_dir):
    return elements.meta_descriptions(samples.product_pages(spark, sf_dir)).drop("site")


@query
def page_headings(spark, sf_dir):
    return elements.headings(samples.pages(spark, sf_dir))


@query
def product_headings(spark, sf_dir):
    return elements.headings(samples.product_pages(spark, sf_dir)).drop("site")


@query
def listed_headings(spark, sf_dir):
    return elements.filled_headings(samples.product_pages(spark, sf_dir)).drop("site", "pos")


@query
def heading_hierarchy(spark, sf_dir):
    return elements.heading_structure(samples.product_pages(spark, sf_dir)).drop("site")


@query
def page_links(spark, sf_dir):
    return elements.listed_links(samples.pages(spark, sf_dir))


@query
def link_type_counts(spark, sf_dir):
    links = elements.listed_links(samples.link_pages(spark, sf_dir))
    return links.groupBy("site", "link_type").agg(F.count("*").alias("links"))


@query
def links_by_scope(spark, sf_dir):
    links = elements.links(samples.link_pages(spark, sf_dir))
    return links.select("page_id", "pos", "url", "anchor_text", "anchor_length", "domain", "scope", "is_empty")


@query
def internal_links(spark, sf_dir):
    return elements.internal_links(samples.link_pages(spark, sf_dir)).drop("site")


@query
def external_domains(spark, sf_dir):
    return site_reports.external_domains(samples.link_pages(spark, sf_dir))


@query
def image_alt_audit(spark, sf_dir):
    return elements.images(samples.product_pages(spark, sf_dir)).drop("site")


@query
def first_ten_images(spark, sf_dir):
    """Of pages that hold twenty."""
    return elements.first_images(samples.gallery_pages(spark, sf_dir)).drop("site")


@query
def first_images(spark, sf_dir):
    return elements.first_images(samples.product_pages(spark, sf_dir), 1).drop("site")


@query
def page_media(spark, sf_dir):
    return elements.media(samples.product_pages(spark, sf_dir)).drop("site")


@query
def page_forms(spark, sf_dir):
    found = elements.forms(samples.form_pages(spark, sf_dir))
    return found.select("page_id", "form_no", "action", "method", F.size("fields").alias("n_fields"))


@query
def form_fields(spark, sf_dir):
    return elements.form_fields(samples.form_pages(spark, sf_dir)).drop("site")


@query
def structured_data(spark, sf_dir):
    found = elements.schema_markup(samples.event_pages(spark, sf_dir))
    return found.select("page_id", "pos", F.try_variant_get("markup", "$.k", "bigint").alias("k"))


@query
def page_metrics(spark, sf_dir):
    return page_extract.page_metrics(samples.pages(spark, sf_dir))


@query
def page_previews(spark, sf_dir):
    return page_extract.previews(samples.pages(spark, sf_dir))


# --- tokens and text figures ------------------------------------------------------------------


@query
def word_counts(spark, sf_dir):
    return _visible(spark, sf_dir).select("page_id", stats.count_of(F.lower("text"), X.WORD).alias("word_count"))


@query
def tokens(spark, sf_dir):
    return terms.tokens(samples.documents(spark, sf_dir))


@query
def sentences(spark, sf_dir):
    return terms.sentences(samples.documents(spark, sf_dir))


@query
def keyword_top20(spark, sf_dir):
    return terms.top_keywords(_visible(spark, sf_dir)).drop("kind")


@query
def bigram_top10(spark, sf_dir):
    return terms.top_phrases(_visible(spark, sf_dir), 2, 10).drop("kind", "total")


@query
def trigram_top5(spark, sf_dir):
    return terms.top_phrases(samples.documents(spark, sf_dir), 3, 5).drop("kind", "total")


@query
def keyword_density(spark, sf_dir):
    return terms.keyword_density(_visible(spark, sf_dir))


@query
def top_words(spark, sf_dir):
    return terms.top_words(samples.documents(spark, sf_dir))


@query
def text_stats(spark, sf_dir):
    figures = texts.text_stats(samples.documents(spark, sf_dir))
    return figures.withColumn("readability_score", F.round("readability_score", 6))


@query
def readability_corpus(spark, sf_dir):
    figures = texts.text_stats(_visible(spark, sf_dir))
    return figures.select("page_id", F.round("readability_score", 6).alias("readability_score"))


@query
def readability_audit(spark, sf_dir):
    facts = audit.page_facts(samples.pages(spark, sf_dir))
    return facts.select("page_id", "flesch_score", "grade_level", "avg_sentence_length", "avg_syllables_per_word")


# --- text forms -------------------------------------------------------------------------------


@query
def raw_text(spark, sf_dir):
    return samples.pages(spark, sf_dir).select("page_id", forms.raw_text(F.col("html")).alias("text"))


@query
def link_text(spark, sf_dir):
    return samples.pages(spark, sf_dir).select("page_id", forms.link_text(F.col("html")).alias("text"))


@query
def visible_text(spark, sf_dir):
    return _visible(spark, sf_dir)


@query
def clean_cells(spark, sf_dir):
    return samples.pages(spark, sf_dir).select("page_id", X.squash(X.decode_entities(F.col("html"))).alias("text"))


@query
def shortcode_clean(spark, sf_dir):
    return texts.shortcode_counts(samples.shortcode_texts(spark, sf_dir))


@query
def pretty_text(spark, sf_dir):
    found = samples.phone_texts(spark, sf_dir)
    return found.select("page_id", forms.directory_text(F.col("text")).alias("text"))


@query
def markdown_lines(spark, sf_dir):
    return texts.markdown_lines(samples.documents(spark, sf_dir))


@query
def markdown_documents(spark, sf_dir):
    found = samples.documents(spark, sf_dir)
    url = samples.template("https://docs.example.com/{page_id}")
    return found.select("page_id", forms.markdown(F.col("text"), F.lit(" Title "), url).alias("markdown"))


@query
def page_text_forms(spark, sf_dir):
    found = samples.pages(spark, sf_dir).withColumn("title", samples.template("Page {page_id}"))
    return texts.page_text(found).select("page_id", "raw_text", "text", "pretty_text", "markdown")


@query
def page_text_businesses(spark, sf_dir):
    """The businesses of a page's map close its directory text."""
    found = samples.marker_pages(spark, sf_dir).withColumn("title", F.lit(" Map "))
    return texts.page_text(found).select("page_id", "pretty_text", F.element_at(F.split("markdown", "\n"), -1).alias("last_line"))


# --- contacts ---------------------------------------------------------------------------------


@query
def contacts_phones(spark, sf_dir):
    found = elements.page_contacts(samples.documents(spark, sf_dir)).where(F.col("kind") == "phone")
    return found.select("page_id", "pattern_no", "value", "normalized")


@query
def contacts_emails(spark, sf_dir):
    found = elements.page_contacts(samples.documents(spark, sf_dir)).where(F.col("kind") == "email")
    return found.select("page_id", "value")


@query
def corpus_contacts(spark, sf_dir):
    return elements.corpus_contacts(samples.documents(spark, sf_dir)).drop("pos")


@query
def contact_urls(spark, sf_dir):
    found = elements.corpus_contacts(samples.address_texts(spark, sf_dir)).where(F.col("kind") == "url")
    return found.select("page_id", "value")


@query
def social_mentions(spark, sf_dir):
    found = elements.page_contacts(samples.address_texts(spark, sf_dir)).where(F.col("kind") == "social")
    return found.select("page_id", "value")


@query
def addresses(spark, sf_dir):
    return elements.corpus_addresses(samples.address_texts(spark, sf_dir))


@query
def address_strings(spark, sf_dir):
    found = elements.page_contacts(samples.address_texts(spark, sf_dir)).where(F.col("kind") == "address")
    return found.select("page_id", "pattern_no", "value")


# --- directories ------------------------------------------------------------------------------


def _flat(businesses: DataFrame, *more: str) -> DataFrame:
    return businesses.select(
        "page_id",
        "name",
        "address",
        "address_url",
        "phone",
        "website_url",
        F.array_join("services", " & ").alias("services"),
        *more,
    )


@query
def directory_blocks(spark, sf_dir):
    found = directory.line_businesses(samples.documents(spark, sf_dir))
    return found.select(
        "page_id", "pos", "name", "address", "phone", F.array_join("services", "|").alias("services"), F.array_join("other_info", "|").alias("other_info")
    )


@query
def directory_sections(spark, sf_dir):
    return _flat(directory.section_businesses(samples.section_pages(spark, sf_dir)))


@query
def shortcode_sections(spark, sf_dir):
    found = directory.sections(samples.section_pages(spark, sf_dir))
    return found.groupBy("page_id").agg(
        F.count("*").alias("sections"), F.count_if(F.size("lines") > 0).alias("filled"), F.sum(F.size("lines")).alias("lines")
    )


@query
def coordinate_lines(spark, sf_dir):
    return directory.marker_lines(samples.section_pages(spark, sf_dir))


@query
def map_markers(spark, sf_dir):
    return directory.map_markers(samples.marker_pages(spark, sf_dir)).drop("pos")


@query
def business_details(spark, sf_dir):
    found = directory.business_details(samples.marker_pages(spark, sf_dir))
    return found.withColumn("services", F.array_join("services", "; ")).drop("pos")


@query
def table_businesses(spark, sf_dir):
    return _flat(directory.table_businesses(samples.directory_texts(spark, sf_dir)))


@query
def map_businesses(spark, sf_dir):
    return _flat(directory.map_businesses(samples.directory_texts(spark, sf_dir)), "lat", "lon")


@query
def business_merge(spark, sf_dir):
    return _flat(directory.merged_businesses(samples.directory_texts(spark, sf_dir)), "source")


@query
def business_source_counts(spark, sf_dir):
    return directory.source_counts(directory.merged_businesses(samples.directory_texts(spark, sf_dir)))


@query
def business_csv(spark, sf_dir):
    merged = directory.merged_businesses(samples.directory_texts(spark, sf_dir))
    return sinks.business_csv(merged)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.match_points(samples.section_pages(spark, sf_dir))


@query
def geo_existing_match(spark, sf_dir):
    return _matched(spark, sf_dir).where(F.col("outcome") == "existing").select("page_id", "pos", "name", "outcome")


@query
def geo_extra_locations(spark, sf_dir):
    return directory.extra_locations(_matched(spark, sf_dir)).select("page_id", "pos", "name", "coordinates")


@query
def geo_new_businesses(spark, sf_dir):
    return _flat(directory.point_businesses(_matched(spark, sf_dir)), "lat", "lon")


@query
def shortcode_businesses(spark, sf_dir):
    found = directory.shortcode_businesses(samples.section_pages(spark, sf_dir))
    return found.select("page_id", "part", "name", "source", sinks.places_text(F.col("extra_locations")).alias("extra_locations"))


@query
def services_labels(spark, sf_dir):
    part = samples.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    # Part names know no services, so letters of theirs stand in for the service words.
    text = F.replace(F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit("bolt"), F.lit("Dock")), F.lit("gear"), F.lit("lift"))
    text = F.replace(F.replace(text, F.lit("ring"), F.lit("dock lift")), F.lit("PROMO"), F.lit("transport TRAILER"))
    rows = part.select("p_partkey", text.alias("text"))
    return rows.select(
        "p_partkey",
        F.array_join(directory.service_labels("name", F.col("text")), ", ").alias("by_name"),
        F.array_join(directory.service_labels("map", F.col("text"), default=True), " & ").alias("by_map"),
        F.array_join(directory.service_labels("cell", F.col("text")), " & ").alias("by_cell"),
    )


@query
def business_route_choice(spark, sf_dir):
    sections = samples.section_pages(spark, sf_dir).withColumn("page_id", F.col("page_id") * 2)
    markers = samples.marker_pages(spark, sf_dir).withColumn("page_id", F.col("page_id") * 2 + 1)
    chosen = directory.page_businesses(sections.unionByName(markers))
    return chosen.groupBy("page_id", "route", "source").agg(F.count("*").alias("businesses"))


@query
def html_blocks(spark, sf_dir):
    found = directory.block_businesses(samples.block_pages(spark, sf_dir))
    return found.select(
        "page_id", "pos", "name", "address", "phone", "is_outermost", F.array_join("services", "|").alias("services"), F.array_join("other_info", "|").alias("other_info")
    )


@query
def directory_listings(spark, sf_dir):
    """Line listings of texts and block listings of pages in one table."""
    found = directory.directory_businesses(samples.block_pages(spark, sf_dir), samples.documents(spark, sf_dir))
    return found.select(
        "page_id", "part", "pos", "name", "address", "phone", F.array_join("services", "|").alias("services"), F.array_join("other_info", "|").alias("other_info")
    )


# --- audit ------------------------------------------------------------------------------------


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.page_audit(samples.pages(spark, sf_dir))


@query
def seo_audit(spark, sf_dir):
    found = _audit(spark, sf_dir)
    codes = {n: F.array_join(F.col(n)["code"], "; ") for n in ("issues", "recommendations")}
    return found.withColumns(codes).drop("url", "title", "description")


@query
def seo_audit_products(spark, sf_dir):
    found = audit.readable_audit(audit.page_audit(samples.product_pages(spark, sf_dir)))
    return found.select(
        "page_id",
        "title_length",
        "description_length",
        "total_images",
        "images_without_alt",
        "image_points",
        F.get(F.filter("issues", lambda i: i.startswith("Meta")), F.lit(0)).alias("description_issue"),
    )


@query
def seo_issue_counts(spark, sf_dir):
    return audit.note_counts(_audit(spark, sf_dir), "issues")


@query
def seo_recommendations(spark, sf_dir):
    return audit.top_notes(_audit(spark, sf_dir), "recommendations", 5)


@query
def site_seo_summary(spark, sf_dir):
    return audit.site_scores(_audit(spark, sf_dir))


@query
def site_issue_report(spark, sf_dir):
    return site_reports.site_issue_report(samples.pages(spark, sf_dir))


@query
def score_bands(spark, sf_dir):
    return audit.score_bands(_audit(spark, sf_dir))


@query
def page_bands(spark, sf_dir):
    return audit.page_bands(_audit(spark, sf_dir))


@query
def report_first_pages(spark, sf_dir):
    return audit.first_pages(_audit(spark, sf_dir)).select("site", "rank", "page_id", "seo_score")


# --- sites ------------------------------------------------------------------------------------


@query
def site_content_summary(spark, sf_dir):
    return rollups.site_content(samples.corpus(spark, sf_dir))


@query
def site_contacts(spark, sf_dir):
    return rollups.site_contacts(samples.corpus(spark, sf_dir))


@query
def category_counts(spark, sf_dir):
    return rollups.category_counts(samples.corpus(spark, sf_dir))


@query
def site_insights(spark, sf_dir):
    return rollups.site_insights(rollups.site_content(samples.corpus(spark, sf_dir))).select("site", "code", "detail", "message")


@query
def site_combined_metrics(spark, sf_dir):
    return site_reports.page_overview(samples.pages(spark, sf_dir))


@query
def page_summary(spark, sf_dir):
    return page_extract.page_summary(samples.pages(spark, sf_dir)).drop("extracted_at")


# --- sources and manifests --------------------------------------------------------------------


@query
def audited_items(spark, sf_dir):
    """Items of type pages as the audit reads them: the blank ones are left out, and posts."""
    items = texts.items_clean(samples.page_items(spark, sf_dir)).withColumnRenamed("id", "page_id")
    pages = items.where(F.col("rest_base") == "pages").select("page_id", "url", "html")
    return audit.page_audit(pages).select("page_id", "site", "title_length", "word_count", "seo_score")


@query
def item_manifest(spark, sf_dir):
    return sinks.item_manifest(samples.page_items(spark, sf_dir))


@query
def media_manifest(spark, sf_dir):
    return sinks.media_manifest(samples.part_media(spark, sf_dir))


@query
def content_types(spark, sf_dir):
    return landed.content_types(samples.type_rows(spark, sf_dir), include_all=True)


@query
def slug_lookup(spark, sf_dir):
    wanted = samples.table(spark, sf_dir, "pages", "url")
    found = landed.find_pages(wanted, samples.page_items(spark, sf_dir))
    return found.select("url", "slug", "id", "rest_base")


@query
def stored_skip(spark, sf_dir):
    items = samples.page_items(spark, sf_dir).select("site", "rest_base", "id")
    return landed.not_stored(items, items.where(F.col("rest_base") == "posts"), ["site", "rest_base", "id"])


@query
def site_folders(spark, sf_dir):
    pages = samples.table(spark, sf_dir, "pages", "page_id", "url")
    name = F.when(F.col("page_id") % 2 == 0, samples.template("Joe's  Shop - & Co. {page_id}"))
    return pages.select("page_id", X.site_folder(name, F.col("url")).alias("folder"))
