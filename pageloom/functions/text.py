"""String expressions: whitespace, tags, entities, words, keys."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]

TAG = "<[^>]+>"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Fn) -> Column:
    """Evaluate a costly value once and use it several times in one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, one group of each."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def upto_last(text: Column, close: str) -> Column:
    """Text up to and with the last closing mark.

    What opens after it has no partner. Patterns of the form open…close search this part only; in the
    whole text every unclosed mark would send them to the end of the page.
    """
    return F.regexp_extract(text, rf"(?is)\A.*{close}", 0)


def sub_closed(text: Column, pattern: str, new: str, close: str) -> Column:
    """regexp_replace for a pattern that ends in a closing mark."""

    def swapped(t: Column) -> Column:
        return let(
            upto_last(t, close),
            lambda head: F.concat(F.regexp_replace(head, pattern, new), F.substr(t, F.length(head) + 1)),
        )

    return let(text, swapped)


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, NULL where there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def strip(text: Column) -> Column:
    """Drop white space at both ends, line breaks included."""
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s++\z", "")


def squash(text: Column) -> Column:
    """Runs of white space become one space."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def drop_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def drop_page_tags(html: Column) -> Column:
    """drop_tags for whole pages, where stray angle brackets may be many."""
    return sub_closed(html, TAG, "", ">")


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return every(text, r"(?U)\S+")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return every(F.lower(text), WORD)


def sub_each(text: Column, pattern: str, change: Fn, close: str = "") -> Column:
    """Replace every match by an expression of the match; close is the mark the pattern ends in, if any."""

    def woven(t: Column) -> Column:
        gaps = F.split(t, pattern, -1)
        changed = F.transform(every(t, pattern), change)
        return F.array_join(F.zip_with(gaps, changed, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")

    def in_head(t: Column) -> Column:
        return let(upto_last(t, close), lambda head: F.concat(woven(head), F.substr(t, F.length(head) + 1)))

    return let(text, in_head if close else woven)


# --- character references -------------------------------------------------------------------

# References handled by plain replacement; a text that uses only these skips the general way.
_PLAIN = ("lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "reg;", "middot;", "ndash;", "mdash;",
          "lsquo;", "rsquo;", "ldquo;", "rdquo;", "hellip;", "bull;", "amp;")
_RARE = "&(?!(?:" + "|".join(_PLAIN) + "))[A-Za-z#]"
_NAME = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <#;]{1,32};?)"
# Names that count without a semicolon, longest first so that the longest prefix wins.
_BARE = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"


def _windows_1252() -> dict[str, str]:
    """What the numbers 128-159 mean in web pages."""
    return {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def _lookup(entries: dict[str, str], key: Column) -> Column:
    """Value of a key in a small constant table, empty where the table lacks it.

    The table is one string literal, which plans and ships faster than a map literal of its size.
    """
    table = F.lit("\x01" + "\x01".join(f"{k}\x02{v}" for k, v in entries.items()) + "\x01")
    after = F.call_function("substring_index", table, F.concat(F.lit("\x01"), key, F.lit("\x02")), F.lit(-1))
    return F.substring_index(after, "\x01", 1)


def _numbered(ref: Column) -> Column:
    """The character of a numeric reference such as #8217; or #x2019;"""
    digits = F.concat(F.lit("0"), F.regexp_replace(ref, r"^#[xX]?0*|;\z", ""))
    number = let(
        digits,
        lambda d: F.when(
            F.length(d) <= 8,
            F.when(ref.rlike("^#[xX]"), F.conv(d, 16, 10)).otherwise(F.conv(d, 10, 10)).cast("long"),
        ),
    )

    def character(code: Column) -> Column:
        unusable = (
            code.between(0x1, 0x8)
            | (code == 0xB)
            | code.between(0xE, 0x1F)
            | (code == 0x7F)
            | code.between(0xFDD0, 0xFDEF)
            | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        )
        return (
            F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
            .when(code.between(0x80, 0x9F), _lookup(_windows_1252(), code.cast("string")))
            .when(unusable, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        )

    return let(number, character)


def _decode_piece(piece: Column) -> Column:
    """Decode the reference a piece starts with; the piece is what follows one ampersand."""

    def after(head: Column) -> Column:
        return F.substr(piece, F.length(head) + 1)

    def by_prefix(bare: Column) -> Column:
        names = {n: c for n, c in html5.items() if not n.endswith(";")}
        return F.when(bare != "", F.concat(_lookup(names, bare), after(bare))).otherwise(
            F.concat(F.lit("&"), piece)
        )

    def by_name(name: Column) -> Column:
        rare = let(
            _lookup(html5, name),
            lambda value: F.when(value != "", F.concat(value, after(name))).otherwise(
                let(F.regexp_extract(name, _BARE, 1), by_prefix)
            ),
        )
        return F.when(name.startswith("#"), F.concat(_numbered(name), after(name))).otherwise(
            let(
                _lookup({n: html5[n] for n in _PLAIN}, name),
                lambda value: F.when(value != "", F.concat(value, after(name))).otherwise(rare),
            )
        )

    return let(F.regexp_extract(piece, _NAME, 1), by_name)


def _decode(text: Column) -> Column:
    plain = text
    for name in _PLAIN:
        plain = F.replace(plain, F.lit("&" + name), F.lit(html5[name]))
    general = let(
        F.split(text, "&", -1),
        lambda pieces: F.concat(
            F.get(pieces, F.lit(0)),
            F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), _decode_piece), ""),
        ),
    )
    return F.when(~text.contains("&"), text).when(~text.rlike(_RARE), plain).otherwise(general)


def decode_entities(text: Column) -> Column:
    """Resolve HTML character references, all in the JVM.

    Texts without an ampersand pass as they are, texts with everyday references take a chain of
    replacements, and only texts with rarer ones are cut at each ampersand and looked up.
    """
    return let(text, _decode)


def decode_all(*texts: Column) -> Column:
    """Several texts decoded as one array; the plan then holds the decoding once."""
    return F.transform(F.array(*texts), _decode)


# --- pages and keys ---------------------------------------------------------------------------


def visible_text(html: Column) -> Column:
    """Text between the tags, references resolved; tags vanish without leaving a space."""
    return decode_entities(drop_page_tags(html))


def authority(url: Column) -> Column:
    """Host with port and user as written, empty where the URL has none."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def site_key(url: Column) -> Column:
    return F.lower(authority(url))


def site_folder(name: Column, url: Column) -> Column:
    """Folder name of a site: its name, else its host, without punctuation."""
    chosen = F.coalesce(F.nullif(name, F.lit("")), authority(url))
    kept = strip(F.regexp_replace(chosen, r"(?U)[^\w\s-]", ""))
    return F.regexp_replace(kept, r"(?U)[-\s]+", "-")


def origin(url: Column) -> Column:
    """Scheme and host of a URL."""
    return F.concat(F.regexp_extract(url, "^([^:/]+)://", 1), F.lit("://"), authority(url))


def absolute(src: Column, base: Column) -> Column:
    """Resolve the two relative forms pages use: //host/path and /path."""
    scheme = F.regexp_extract(base, "^([^:/]+):", 1)
    return (
        F.when(src.startswith("//"), F.concat(scheme, F.lit(":"), src))
        .when(src.startswith("/"), F.concat(origin(base), src))
        .otherwise(src)
    )


def slug(url: Column) -> Column:
    """Last part of the URL path, home where the path is empty."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("home"))


def preview(text: Column, limit: int = 1000) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Value of a quoted attribute of one tag, NULL where the tag lacks it."""
    quoted = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return let(quoted, lambda q: F.when(q != "", F.substr(q, F.lit(2), F.length(q) - 2)))


def has_all(text: Column, needles: tuple[str, ...]) -> Column:
    held = F.lit(True)
    for needle in needles:
        held = held & text.contains(needle)
    return held


def has_any(text: Column, needles: tuple[str, ...]) -> Column:
    held = F.lit(False)
    for needle in needles:
        held = held | text.contains(needle)
    return held
