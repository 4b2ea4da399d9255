"""Child tables of pages: headings, links, media, forms, tags, structured data, contacts.

Input: pages(page_id, url, html) or texts(page_id, text). The HTML column is dropped as soon as the
elements are out of it; children carry page_id, site and pos only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import markup as M
from pageloom.functions import text as X
from pageloom.functions.fixed import BRAND_WORDS
from pageloom.functions.rows import exploded


def _html() -> Column:
    return F.col("html")


def _url() -> Column:
    return F.col("url")


# How each element array is read off a page.
_ARRAYS = {
    "headings": lambda: M.headings(_html()),
    "links": lambda: M.links(_html()),
    "images": lambda: M.images(_html(), _url()),
    "media": lambda: M.media_urls(_html(), _url()),
    "forms": lambda: M.forms(_html()),
    "json_ld": lambda: M.json_ld(_html()),
    "tags": lambda: M.metas(F.col("head")),
}


def array_of(pages: DataFrame, name: str) -> Column:
    """An element array of the pages: the stored column of parsed pages, else read off the HTML."""
    return F.col(name) if name in pages.columns else _ARRAYS[name]()


def parsed(pages: DataFrame) -> DataFrame:
    """Pages with all element arrays beside the HTML, for writing once where many child tables follow.

    The child jobs take the arrays from a table that has them and do not touch its HTML again.
    """
    return with_heads(pages).select("*", *[array().alias(name) for name, array in _ARRAYS.items()])


def _explode(pages: DataFrame, elements: Column, *keep: Column) -> DataFrame:
    """One row per element with its position; pages without elements give no row."""
    return exploded(pages, elements, "page_id", X.site_key(_url()).alias("site"), *keep)


def headings(pages: DataFrame) -> DataFrame:
    """All headings level by level, with the empty ones flagged."""
    rows = _explode(pages, array_of(pages, "headings")).select(
        "page_id", "site", "pos", F.col("e.level").alias("level"), X.decode_entities(F.col("e.text")).alias("text")
    )
    return rows.select(
        "*",
        F.length("text").alias("length"),
        X.word_count(F.col("text")).alias("word_count"),
        (F.col("text") == "").alias("is_empty"),
    )


def filled_headings(pages: DataFrame) -> DataFrame:
    """Headings as the page listing shows them: no empty ones, level written H1..H6."""
    rows = _explode(pages, array_of(pages, "headings")).where(F.col("e.text") != "")
    return rows.select(
        "page_id", "site", "pos", F.concat(F.lit("H"), F.col("e.level")).alias("level"), F.col("e.text").alias("text")
    )


def heading_structure(pages: DataFrame) -> DataFrame:
    """Heading counts of each page and whether its levels follow each other."""
    rows = pages.select("page_id", X.site_key(_url()).alias("site"), M.heading_levels(_html()).alias("n"))
    return rows.select(
        "page_id",
        "site",
        *[F.get("n", F.lit(i)).alias(f"h{i + 1}_count") for i in range(6)],
        sum((F.get("n", F.lit(i)) for i in range(6)), F.lit(0)).alias("total_headings"),
        M.hierarchy_ok(F.col("n")).alias("has_proper_hierarchy"),
    )


def links(pages: DataFrame) -> DataFrame:
    """All anchors: text, kind by look (link_type) and against the page's domain (scope)."""
    rows = _explode(pages, array_of(pages, "links"), _url().alias("page_url"), X.authority(_url()).alias("page_domain")).select(
        "page_id",
        "site",
        "pos",
        "page_url",
        "page_domain",
        F.col("e.url").alias("url"),
        F.col("e.text").alias("text"),
        X.decode_entities(F.col("e.text")).alias("anchor_text"),
    )
    return rows.select(
        "page_id",
        "site",
        "pos",
        "url",
        "text",
        "anchor_text",
        F.length("anchor_text").alias("anchor_length"),
        X.authority(F.col("url")).alias("domain"),
        M.link_type(F.col("url")).alias("link_type"),
        M.link_scope(F.col("url"), F.col("page_url"), F.col("page_domain")).alias("scope"),
        ((F.col("url") == "") | (F.col("text") == "")).alias("is_empty"),
    )


def listed_links(pages: DataFrame) -> DataFrame:
    """Links as the page listing shows them: neither target nor text empty."""
    rows = _explode(pages, array_of(pages, "links")).where((F.col("e.url") != "") & (F.col("e.text") != ""))
    return rows.select(
        "page_id", "site", "pos", "e.url", "e.text", M.link_type(F.col("e.url")).alias("link_type")
    )


def internal_links(pages: DataFrame) -> DataFrame:
    return links(pages).where(F.col("scope") == "internal").select("page_id", "site", "pos", "url", "anchor_text", "anchor_length")


def external_links(pages: DataFrame) -> DataFrame:
    return links(pages).where(F.col("scope") == "external").select("page_id", "site", "pos", "url", "anchor_text", "domain")


def images(pages: DataFrame) -> DataFrame:
    return _explode(pages, array_of(pages, "images")).select(
        "page_id",
        "site",
        "pos",
        "e.src",
        F.col("e.url").alias("url"),
        "e.alt",
        "e.title",
        "e.has_alt",
        F.length("e.alt").alias("alt_length"),
    )


def first_images(pages: DataFrame, k: int = 10) -> DataFrame:
    """The first k images of each page; cut inside the row, before anything is exploded."""
    return _explode(pages, F.slice(array_of(pages, "images"), 1, k)).select("page_id", "site", "pos", "e.src", "e.alt", "e.has_alt")


def media(pages: DataFrame) -> DataFrame:
    """Images with a source, videos and audio files with absolute URLs."""
    pictures = F.transform(
        F.filter(array_of(pages, "images"), lambda i: i["src"] != ""),
        lambda i: F.struct(
            F.lit("image").alias("kind"), F.lit(1).alias("pattern_no"), i["url"].alias("url"), i["alt"].alias("alt")
        ),
    )
    others = F.transform(
        array_of(pages, "media"),
        lambda m: F.struct(m["kind"].alias("kind"), m["pattern_no"].alias("pattern_no"), m["url"].alias("url"), F.lit("").alias("alt")),
    )
    return _explode(pages, F.concat(pictures, others)).select("page_id", "site", "pos", "e.kind", "e.pattern_no", F.col("e.url").alias("src"), "e.alt")


def forms(pages: DataFrame) -> DataFrame:
    return _explode(pages, array_of(pages, "forms")).select(
        "page_id", "site", F.col("pos").alias("form_no"), "e.action", "e.method", M.form_fields(F.col("e.body")).alias("fields")
    )


def form_fields(pages: DataFrame) -> DataFrame:
    return exploded(forms(pages), "fields", "page_id", "site", "form_no").select(
        "page_id", "site", "form_no", "pos", "e.name", "e.type"
    )


def _head_source() -> Column:
    """Head markup of SEO plugins where an item brings it, else the page itself."""
    return F.coalesce(F.nullif(F.col("yoast_head"), F.lit("")), F.nullif(F.col("rankmath_head"), F.lit("")), _html())


def seo_tag_columns(source: Column, tags: Column) -> list[Column]:
    def or_empty(value: Column) -> Column:
        return F.coalesce(value, F.lit(""))

    return [
        M.title(source).alias("meta_title"),
        or_empty(M.meta(tags, "description")).alias("meta_description"),
        or_empty(M.meta(tags, "keywords")).alias("meta_keywords"),
        or_empty(M.meta(tags, "og:title")).alias("og_title"),
        or_empty(M.meta(tags, "og:description")).alias("og_description"),
        or_empty(M.meta(tags, "og:image")).alias("og_image"),
        or_empty(M.canonical(source)).alias("canonical_url"),
        or_empty(M.meta(tags, "robots")).alias("robots"),
        or_empty(M.meta(tags, "twitter:card")).alias("twitter_card"),
    ]


def with_heads(pages: DataFrame) -> DataFrame:
    """Pages with a column 'head': where their SEO tags are read from."""
    if "head" in pages.columns:
        return pages
    for name in ("yoast_head", "rankmath_head"):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast("string"))
    return pages.withColumn("head", _head_source())


def seo_tags(pages: DataFrame) -> DataFrame:
    headed = with_heads(pages)
    rows = headed.select("page_id", X.site_key(_url()).alias("site"), "head", array_of(headed, "tags").alias("tags"))
    return rows.select("page_id", "site", *seo_tag_columns(F.col("head"), F.col("tags")))


def schema_markup(pages: DataFrame) -> DataFrame:
    """Structured-data scripts that hold valid JSON, one variant each."""
    return _explode(pages, array_of(pages, "json_ld")).withColumnRenamed("e", "markup")


def page_titles(pages: DataFrame, brand_words: tuple[str, ...] = BRAND_WORDS) -> DataFrame:
    rows = pages.select("page_id", X.site_key(_url()).alias("site"), X.decode_entities(M.title(_html())).alias("title"))
    return rows.select(
        "*",
        F.length("title").alias("length"),
        X.word_count(F.col("title")).alias("word_count"),
        X.has_any(F.lower("title"), brand_words).alias("has_brand"),
        F.length("title").between(30, 60).alias("optimal_length"),
    )


def meta_descriptions(pages: DataFrame) -> DataFrame:
    found = M.meta(M.metas(_html()), "description")
    rows = pages.select(
        "page_id", X.site_key(_url()).alias("site"), X.decode_entities(F.coalesce(found, F.lit(""))).alias("description")
    )
    return rows.select(
        "*",
        F.length("description").alias("length"),
        X.word_count(F.col("description")).alias("word_count"),
        F.length("description").between(120, 160).alias("optimal_length"),
    )


def page_contacts(texts: DataFrame, same_line: bool = False) -> DataFrame:
    """Contacts of page texts: phones and addresses with repeats, e-mails and networks once.

    normalized makes spellings of one phone comparable; it is NULL for the other kinds.
    """
    text = F.col("text")

    def kind(name: str, found: Column, numbered: bool = False) -> Column:
        return F.transform(
            found,
            lambda v: F.struct(
                F.lit(name).alias("kind"),
                (v["pattern_no"] if numbered else F.lit(1)).alias("pattern_no"),
                (v["value"] if numbered else v).alias("value"),
            ),
        )

    found = M.flat(
        [
            kind("phone", M.page_phones(text), True),
            kind("email", M.emails(text)),
            kind("address", M.page_addresses(text, same_line), True),
            kind("social", M.social(text)),
        ]
    )
    return exploded(texts, found, "page_id").select(
        "page_id",
        "pos",
        "e.kind",
        "e.pattern_no",
        "e.value",
        F.when(F.col("e.kind") == "phone", M.ten_digits(F.col("e.value"))).alias("normalized"),
    )


def corpus_contact_array(text: Column) -> Column:
    """array<struct<kind, value>>: phones, e-mails and URLs, each value once."""

    def kind(name: str, found: Column) -> Column:
        return F.transform(found, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))

    return M.flat([kind("phone", M.corpus_phones(text)), kind("email", M.emails(text)), kind("url", M.urls(text))])


def corpus_contacts(texts: DataFrame) -> DataFrame:
    """Contacts of corpus texts, each value once per text: phones, e-mails, URLs."""
    keys = [c for c in texts.columns if c != "text"]
    rows = exploded(texts, corpus_contact_array(F.col("text")), *keys)
    return rows.select(*keys, "pos", "e.kind", "e.value")


def corpus_addresses(texts: DataFrame) -> DataFrame:
    keys = [c for c in texts.columns if c != "text"]
    return exploded(texts, M.corpus_addresses(F.col("text")), *keys).select(
        *keys, "pos", "e.city", "e.state", "e.zip_code"
    )
