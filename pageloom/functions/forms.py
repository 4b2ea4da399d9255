"""The three text forms of a page: raw, directory and markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions import fixed, patterns
from pageloom.functions.text import attribute, decode_entities, drop_page_tags, drop_tags, let, strip, sub_closed, sub_each

ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"[^"]*"|'[^']*')[^>]*>.*?</a>"""
FILLED_ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"[^"]+"|'[^']+')[^>]*>.*?</a>"""


def raw_text(html: Column) -> Column:
    """Tags dropped, line breaks at paragraph ends; references stay as written."""
    text = html
    for tag in ("script", "style"):  # each up to its own last closing mark
        text = sub_closed(text, rf"(?is)<{tag}.*?</{tag}>", "", f"</{tag}>")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6])>", "\n")
    text = F.regexp_replace(drop_page_tags(text), r"\n{3,}", "\n\n")
    return strip(text)


def _link_as_text(anchor: Column) -> Column:
    href = attribute(F.regexp_extract(anchor, "^<[^>]*>", 0), "href")
    return F.concat(strip(drop_tags(anchor)), F.lit(" | "), strip(href))


def link_text(html: Column) -> Column:
    """Readable text that keeps link targets and marks headings."""
    text = decode_entities(F.coalesce(html, F.lit("")))
    for tag in ("script", "style", "noscript"):
        text = sub_closed(text, rf"(?is)<{tag}.*?</{tag}>", "", f"</{tag}>")
    text = sub_each(text, FILLED_ANCHOR, _link_as_text, "</a>")
    for level in range(1, 7):
        text = sub_closed(text, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", f"[H{level}] $1", f"</h{level}>")
    text = F.regexp_replace(
        text, r"(?i)<br\s*/?>|</(?:p|div|li|article|section|header|footer|nav|main)>", "\n"
    )
    text = F.regexp_replace(drop_page_tags(text), r"\r?\n[ \t]+", "\n")
    text = F.regexp_replace(text, r"(?<![ \t])[ \t]++\r?\n", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def drop_shortcodes(text: Column) -> Column:
    """Page-builder shortcodes go, their contents stay."""
    builders = "(?i)" + "|".join(p.removeprefix("(?i)") for p in fixed.SHORTCODES.values())

    def cleaned(t: Column) -> Column:
        kept = F.regexp_replace(F.regexp_replace(t, fixed.RAW_HTML_SHORTCODE, ""), builders, "")
        return F.when(t.contains("["), F.regexp_replace(kept, fixed.OTHER_SHORTCODE, "")).otherwise(t)

    return let(text, cleaned)


def drop_marker_noise(text: Column) -> Column:
    """Remove what map widgets leave behind in a text."""
    text = F.regexp_replace(text, fixed.MAP_SHORTCODE, "")
    text = F.regexp_replace(text, patterns.MAP_POINT_LINE, "")
    return F.regexp_replace(text, fixed.MAP_URL, fixed.MAP_LINK)


def directory_text(text: Column) -> Column:
    """One fact per line: phones in one shape, breaks before labels and after ZIP codes."""
    text = drop_marker_noise(drop_shortcodes(text))
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?<!\n)(Website\s*\|)", "\n$1")
    text = F.regexp_replace(text, fixed.ANY_PHONE, "$1$2-$3-$4")
    text = F.regexp_replace(text, rf"(?<!\n)({fixed.DASHED_PHONE})", "\n$1")
    text = F.regexp_replace(text, r"\b(\d{5}(?:-\d{4})?)\b(?!-\d)(?!\n)", "$1\n")
    text = F.regexp_replace(text, rf"(?<!{patterns.BLANK}){patterns.BLANK}++(?=\n|\z)", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def listing_block(businesses: Column) -> Column:
    """The JSON block that closes a directory text, empty without businesses."""

    def block(listed: Column) -> Column:
        parts = [F.lit(x) for x in ("\n", fixed.LISTING_RULE, fixed.LISTING_TITLE, fixed.LISTING_RULE)]
        return F.when(F.size(listed) > 0, F.concat_ws("\n", *parts, F.to_json(listed))).otherwise("")

    return let(businesses, block)


def with_title(title: Column, text: Column) -> Column:
    head = strip(F.coalesce(title, F.lit("")))
    return F.when(head != "", strip(F.concat(head, F.lit("\n\n"), text))).otherwise(text)


# --- markdown ---------------------------------------------------------------------------------


def line_class(line: Column) -> Column:
    """blank, heading or text."""
    head = F.substring(line, 1, 1)
    title_like = (
        (F.length(line) < 60)
        & ~line.endswith(".")
        & ~line.startswith("http")
        & ~line.rlike(fixed.DASHED_PHONE)
        & (head == F.upper(head))
        & (head != F.lower(head))
    )
    return F.when(line == "", "blank").when(title_like, "heading").otherwise("text")


def markdown_line(line: Column) -> Column:
    """Decorate one stripped line of class text; a line that matches nothing stays as it is."""
    phone = F.when(line.rlike(fixed.DASHED_PHONE), F.concat(F.lit(fixed.PHONE_MARK), line)).otherwise(line)
    return let(let(let(phone, _website_line), _email_line), _address_line)


def _website_line(line: Column) -> Column:
    target = F.when(line.contains("| "), F.regexp_extract(line, r"(?s)^.*?\| (.*)", 1)).otherwise(
        F.replace(line, F.lit("Website "), F.lit(""))
    )
    shown = F.concat(F.lit(fixed.WEBSITE_MARK + "["), target, F.lit("]("), target, F.lit(")"))
    return F.when(line.startswith("Website |"), shown).otherwise(line)


def _email_line(line: Column) -> Column:
    """A line with an e-mail address shows nothing else."""

    def shown(email: Column) -> Column:
        mail = F.concat(F.lit(fixed.EMAIL_MARK + "["), email, F.lit("](mailto:"), email, F.lit(")"))
        return F.when(email != "", mail).otherwise(line)

    return F.when(line.contains("@"), let(F.regexp_extract(line, patterns.EMAIL, 0), shown)).otherwise(line)


def _address_line(line: Column) -> Column:
    held = line.rlike(patterns.STATE_AND_ZIP) & line.rlike(patterns.CITY)
    return F.when(held, F.concat(F.lit(fixed.ADDRESS_MARK), line)).otherwise(line)


def text_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), strip)


def markdown(text: Column, title: Column, url: Column) -> Column:
    """The whole markdown document of a text, empty for an empty text."""

    def body(lines: Column) -> Column:
        kinds = F.transform(lines, line_class)
        return let(kinds, lambda known: F.transform(lines, lambda line, i: block(known, line, i)))

    def block(kinds: Column, line: Column, i: Column) -> Column:
        kind = F.get(kinds, i)
        after_text = (i > 0) & (F.get(kinds, i - 1) == "text")
        gap = F.when(after_text, F.lit("\n")).otherwise("")
        return (
            F.when(kind == "heading", F.concat(gap, F.lit("## "), line, F.lit("\n")))
            .when(kind == "text", markdown_line(line))
            .when(after_text, F.lit(""))
        )

    head = strip(F.coalesce(title, F.lit("")))
    link = F.coalesce(url, F.lit(""))
    none = F.array().cast("array<string>")
    source = F.array(
        F.concat(F.lit("**Source:** ["), link, F.lit("]("), link, F.lit(")")), F.lit(""), F.lit("---"), F.lit("")
    )

    def document(t: Column) -> Column:
        parts = F.concat(
            F.when(head != "", F.array(F.concat(F.lit("# "), head), F.lit(""))).otherwise(none),
            F.when(link != "", source).otherwise(none),
            let(text_lines(t), body),
        )
        return F.when(t != "", F.array_join(parts, "\n")).otherwise("")

    return let(text, document)
