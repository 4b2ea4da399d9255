"""Page elements as array columns, read off the HTML of one row.

A page's elements never outgrow its own row, so arrays are safe here, and a figure per page needs no
shuffle. Jobs that want one row per element explode these arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import fixed, patterns
from pageloom.functions.forms import ANCHOR
from pageloom.functions.text import absolute, attribute, drop_tags, every, let, strip, upto_last

OPEN_TAG = "^<[^>]*>"
PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>.*?</p>"
IMAGE = r"(?i)<img\b[^>]*>"
FORM = r"(?is)<form\b[^>]*>.*?</form>"
# Tags whose quoted values may hold any character, the closing bracket too.
META = r"""(?i)<meta\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
LINK_TAG = r"""(?i)<link\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


def open_tags(html: Column, pattern: str) -> Column:
    """All tags of a pattern that ends in `>`; a tag that never closes sends no search to the end of the page."""
    return every(upto_last(html, ">"), pattern)


def flat(arrays: list[Column]) -> Column:
    return F.flatten(F.array(*arrays))


def headings(html: Column) -> Column:
    """array<struct<level, text>>, level by level; empty headings included."""

    def of_level(level: int) -> Column:
        bodies = every(upto_last(html, f"</h{level}>"), rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", 1)
        return F.transform(
            bodies,
            lambda b: F.struct(F.lit(level).alias("level"), strip(drop_tags(b)).alias("text")),
        )

    return flat([of_level(level) for level in range(1, 7)])


def heading_levels(html: Column) -> Column:
    """Number of headings of each level, array of six counts.

    One pass takes the heading tags out of the page, and only those few are searched level by level.
    """
    tags = F.array_join(every(html, "(?i)<h[1-6][^>]*>|</h[1-6]>"), "")

    def count(t: Column, n: int) -> Column:
        return F.regexp_count(upto_last(t, f"</h{n}>"), F.lit(rf"(?is)<h{n}[^>]*>.*?</h{n}>"))

    return let(tags, lambda t: F.array(*[count(t, n) for n in range(1, 7)]))


def hierarchy_ok(counts: Column) -> Column:
    """Exactly one level-1 heading, and no level skipped between the first and last used."""
    used = F.array_join(F.transform(counts, lambda n: F.when(n > 0, "1").otherwise("0")), "")
    return (F.get(counts, F.lit(0)) == 1) & used.rlike("^1+0*$")


def _anchors(html: Column) -> Column:
    return every(upto_last(html, "</a>"), ANCHOR)


def links(html: Column) -> Column:
    """array<struct<url, text>> of all anchors with a quoted target; empty ones included."""
    return F.transform(
        _anchors(html),
        lambda a: F.struct(
            attribute(F.regexp_extract(a, OPEN_TAG, 0), "href").alias("url"),
            strip(drop_tags(a)).alias("text"),
        ),
    )


def link_urls(html: Column) -> Column:
    return F.transform(_anchors(html), lambda a: attribute(F.regexp_extract(a, OPEN_TAG, 0), "href"))


def link_type(url: Column) -> Column:
    """By the look of the target alone: only http(s) targets are external."""
    return F.when(url.startswith("http://") | url.startswith("https://"), "external").otherwise("internal")


def link_scope(url: Column, page_url: Column, domain: Column) -> Column:
    """Against the page's own domain: a target holding it anywhere is internal; NULL without a page URL."""
    outside = url.startswith("http") & ~url.contains(domain)
    return F.when(page_url != "", F.when(outside, "external").otherwise("internal"))


def images(html: Column, base: Column) -> Column:
    """array<struct<src, url, alt, title, has_alt>>; src as written, url made absolute."""

    def image(tag: Column) -> Column:
        src = F.coalesce(attribute(tag, "src"), F.lit(""))
        alt = attribute(tag, "alt")
        return F.struct(
            src.alias("src"),
            absolute(src, base).alias("url"),
            F.coalesce(alt, F.lit("")).alias("alt"),
            F.coalesce(attribute(tag, "title"), F.lit("")).alias("title"),
            alt.isNotNull().alias("has_alt"),
        )

    return F.transform(open_tags(html, IMAGE), image)


def media_urls(html: Column, base: Column) -> Column:
    """array<struct<kind, pattern_no, url>> of videos and audio files."""

    def of(kind: str, number: int, tag: str, wanted: str) -> Column:
        sources = F.transform(open_tags(html, rf"(?i)<{tag}\b[^>]*>"), lambda t: attribute(t, "src"))
        kept = F.filter(sources, lambda s: (s != "") & s.rlike(wanted))
        return F.transform(
            kept,
            lambda s: F.struct(
                F.lit(kind).alias("kind"), F.lit(number).alias("pattern_no"), absolute(s, base).alias("url")
            ),
        )

    return flat(
        [
            of("video", 1, "video", ""),
            of("video", 2, "iframe", fixed.VIDEO_HOSTS),
            of("video", 3, "embed", "(?i)video"),
            of("audio", 1, "audio", ""),
        ]
    )


def paragraph_count(html: Column) -> Column:
    return F.regexp_count(upto_last(html, "</p>"), F.lit(PARAGRAPH))


def form_count(html: Column) -> Column:
    return F.regexp_count(upto_last(html, "</form>"), F.lit(FORM))


def forms(html: Column) -> Column:
    """array<struct<action, method, body>>."""

    def form(markup: Column) -> Column:
        tag = F.regexp_extract(markup, OPEN_TAG, 0)
        return F.struct(
            F.coalesce(attribute(tag, "action"), F.lit("")).alias("action"),
            F.upper(F.coalesce(attribute(tag, "method"), F.lit("GET"))).alias("method"),
            markup.alias("body"),
        )

    return F.transform(every(upto_last(html, "</form>"), FORM), form)


def form_fields(body: Column) -> Column:
    """array<struct<name, type>>: inputs, then text areas, then selects."""

    def of(tag: str) -> Column:
        fields = F.transform(
            open_tags(body, rf"(?i)<{tag}\b[^>]*>"),
            lambda t: F.struct(
                attribute(t, "name").alias("name"),
                (F.coalesce(attribute(t, "type"), F.lit("text")) if tag == "input" else F.lit("text")).alias(
                    "type"
                ),
            ),
        )
        return F.filter(fields, lambda f: f["name"].isNotNull())

    return flat([of("input"), of("textarea"), of("select")])


def title(html: Column) -> Column:
    """Stripped title text, references unresolved; empty without a title tag."""
    return strip(F.regexp_extract(upto_last(html, "</title>"), fixed.TITLE, 1))


def metas(html: Column) -> Column:
    """array<struct<key, content>>: key is the lower-cased name or property of a meta tag."""
    return F.transform(
        every(html, META),
        lambda t: F.struct(
            F.lower(F.coalesce(attribute(t, "name"), attribute(t, "property"))).alias("key"),
            attribute(t, "content").alias("content"),
        ),
    )


def meta(tags: Column, key: str) -> Column:
    """Stripped content of the first meta tag with a key, NULL without one."""
    found = F.filter(tags, lambda m: (m["key"] == key) & m["content"].isNotNull())
    return strip(F.get(found, F.lit(0))["content"])


def canonical(html: Column) -> Column:
    found = F.filter(every(html, LINK_TAG), lambda t: F.lower(attribute(t, "rel")) == "canonical")
    return strip(attribute(F.get(found, F.lit(0)), "href"))


def json_ld(html: Column) -> Column:
    """array<variant> of the structured-data scripts that parse."""
    parsed = F.transform(every(upto_last(html, "</script>"), fixed.JSON_LD, 1), lambda s: F.try_parse_json(strip(s)))
    return F.filter(parsed, lambda v: v.isNotNull())


# --- contacts ---------------------------------------------------------------------------------


def page_phones(text: Column) -> Column:
    """array<struct<pattern_no, value>> of three phone shapes, repeats kept."""
    return flat(
        [
            F.transform(
                every(text, p), lambda v: F.struct(F.lit(n).alias("pattern_no"), v.alias("value"))
            )
            for n, p in enumerate(fixed.PAGE_PHONES, 1)
        ]
    )


def ten_digits(phone: Column) -> Column:
    """Last ten digits of a phone, so that different spellings compare equal."""
    digits = F.regexp_replace(phone, r"\D", "")
    return F.right(digits, F.lit(10))


def emails(text: Column) -> Column:
    found = F.array_distinct(every(text, patterns.EMAIL))
    return F.when(text.contains("@"), found).otherwise(F.array().cast("array<string>"))


def urls(text: Column) -> Column:
    return F.array_distinct(every(text, fixed.WEB_URL))


def corpus_phones(text: Column) -> Column:
    return F.array_distinct(every(text, fixed.CORPUS_PHONE))


def page_addresses(text: Column, same_line: bool = False) -> Column:
    """array<struct<pattern_no, value>>: with a street, then from the city on."""
    city = patterns.CITY_SAME_LINE if same_line else patterns.CITY
    found = flat(
        [
            F.transform(
                every(text, p, 1), lambda v: F.struct(F.lit(n).alias("pattern_no"), v.alias("value"))
            )
            for n, p in enumerate((patterns.STREET, city), 1)
        ]
    )
    return F.when(text.rlike(patterns.STATE_AND_ZIP), found).otherwise(
        F.array().cast("array<struct<pattern_no:int,value:string>>")
    )


def corpus_addresses(text: Column) -> Column:
    """array<struct<city, state, zip_code>>."""
    found = F.transform(
        every(text, patterns.CITY, 1),
        lambda a: F.struct(
            F.regexp_extract(a, patterns.CITY, 2).alias("city"),
            F.regexp_extract(a, patterns.CITY, 3).alias("state"),
            F.regexp_extract(a, patterns.CITY, 4).alias("zip_code"),
        ),
    )
    return F.when(text.rlike(patterns.STATE_AND_ZIP), found).otherwise(
        F.array().cast("array<struct<city:string,state:string,zip_code:string>>")
    )


def social(text: Column) -> Column:
    lower = F.lower(text)
    return F.array_compact(F.array(*[F.when(lower.contains(w), F.lit(w)) for w in fixed.SOCIAL_WORDS]))


