"""Business directories: listings read from text lines, shortcode sections, table rows, map markers and
HTML blocks, then matched, merged and de-duplicated.

What belongs to one page is read inside its row, from its HTML to its list of businesses: a page never shuffles.
Each kind of listing is an array of raw entries and a record of one entry, used both for arrays and for rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pageloom.functions import fixed, forms, lookup
from pageloom.functions import text as X
from pageloom.functions.blocks import html_blocks
from pageloom.functions.rows import exploded
from pageloom.functions.text import every, first, let, squash, strip

EXTRA = "array<struct<name:string,lat:double,lon:double>>"
BUSINESS = {
    "name": "string",
    "address": "string",
    "address_url": "string",
    "phone": "string",
    "website_url": "string",
    "email": "string",
    "lat": "double",
    "lon": "double",
    "services": "array<string>",
    "extra_locations": EXTRA,
    "other_info": "array<string>",
    "source": "string",
}


def _record(pos: Column, part: int = 1, **known: Column) -> Column:
    """A business as struct<part, pos, ...>; what a route does not read is NULL."""
    columns = [known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in BUSINESS.items()]
    return F.struct(F.lit(part).alias("part"), pos.cast("int").alias("pos"), *columns)


def _rows(entries: DataFrame, record: Column, *more: str) -> DataFrame:
    """Rows (page_id, pos, more, business columns) of raw entries(page_id, pos, e)."""
    return entries.select("page_id", *more, record.alias("b")).select("page_id", "b.pos", *more, *[f"b.{c}" for c in BUSINESS])


def service_labels(rule_set: str, text: Column, default: bool = False) -> Column:
    """Labels of the services a text names, by one of the rule sets."""
    lower = F.lower(text)
    labels = [
        F.when(X.has_all(lower, wanted) & ~X.has_any(lower, barred), F.lit(label))
        for rules, label, wanted, barred in fixed.SERVICE_RULES
        if rules == rule_set
    ]
    found = F.array_distinct(F.array_compact(F.array(*labels)))
    if not default:
        return found
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit(fixed.DEFAULT_SERVICE))))


# --- lines ------------------------------------------------------------------------------------


def _is_header(line: Column) -> Column:
    """An all-capitals line of two words or more that is neither a phone nor a street."""
    capital = (line == F.upper(line)) & (line != F.lower(line))
    return (
        capital
        & line.rlike(r"(?U)\S\s+\S")
        & ~line.rlike(fixed.PAGE_PHONES[0])
        & ~F.lower(line).rlike(fixed.STREET_LINE)
    )


def _line_kind(line: Column) -> Column:
    lower = F.lower(line)
    return (
        F.when(line.rlike(fixed.LISTING_PHONE), "phone")
        .when(lower.rlike(fixed.STREET_LINE), "street")
        .when(line.rlike(fixed.STATE_ZIP), "zip")
        .when(X.has_any(lower, fixed.SERVICE_WORDS), "service")
        .otherwise("other")
    )


def _listing(lines: Column) -> Column:
    """struct of what the lines below a business name say.

    The last phone counts. A street line replaces the address so far, a line with state and ZIP is
    added to it; so the address is the last street line and the ZIP lines after it.
    """
    sorted_lines = F.transform(lines, lambda line: F.struct(_line_kind(line).alias("kind"), line.alias("line")))

    def of(items: Column, kind: str) -> Column:
        return F.transform(F.filter(items, lambda x: x["kind"] == kind), lambda x: x["line"])

    def read(items: Column) -> Column:
        places = F.filter(items, lambda x: x["kind"].isin("street", "zip"))
        address = let(
            places,
            lambda p: let(
                F.array_max(F.transform(p, lambda x, i: F.when(x["kind"] == "street", i))),
                lambda last: F.array_join(
                    F.transform(F.filter(p, lambda x, i: i >= F.coalesce(last, F.lit(0))), lambda x: x["line"]),
                    ", ",
                ),
            ),
        )
        phone = F.try_element_at(of(items, "phone"), F.lit(-1))
        return F.struct(
            address.alias("address"),
            F.regexp_extract(F.coalesce(phone, F.lit("")), fixed.LISTING_PHONE, 0).alias("phone"),
            of(items, "service").alias("services"),
            of(items, "other").alias("other_info"),
        )

    return let(sorted_lines, read)


def _filled_lines(text: Column) -> Column:
    return F.filter(forms.text_lines(text), lambda line: line != "")


def line_block_array(text: Column) -> Column:
    """array<struct<name, lines>>: an all-capitals name line and the lines up to the next one."""

    def blocks(lines: Column) -> Column:
        at = F.transform(lines, lambda line, i: F.when(_is_header(line), i))
        return let(F.array_compact(at), lambda heads: F.transform(heads, lambda head, k: block(lines, heads, head, k)))

    def block(lines: Column, heads: Column, head: Column, k: Column) -> Column:
        end = F.coalesce(F.get(heads, k + 1), F.size(lines))
        return F.struct(F.get(lines, head).alias("name"), F.slice(lines, head + 2, end - head - 1).alias("lines"))

    return let(_filled_lines(text), blocks)


def _listing_record(pos: Column, part: int, name: Column, lines: Column, source: str) -> Column:
    return let(
        _listing(lines),
        lambda r: _record(
            pos,
            part,
            name=name,
            address=r["address"],
            phone=r["phone"],
            services=r["services"],
            other_info=r["other_info"],
            source=F.lit(source),
        ),
    )


def _line_record(e: Column, pos: Column) -> Column:
    return _listing_record(pos, 1, e["name"], e["lines"], "lines")


def line_businesses(texts: DataFrame) -> DataFrame:
    """Listings of texts(page_id, text) that open with an all-capitals name line."""
    return _rows(exploded(texts, line_block_array(F.col("text")), "page_id"), _line_record(F.col("e"), F.col("pos")))


def _has_blocks(html: Column) -> Column:
    """Lets through every page the parser could find a block on, and many it finds none on."""
    return html.rlike("(?i)" + "|".join(fixed.BLOCK_CLASSES))


def block_array(html: Column) -> Column:
    """array<struct<block_no, is_outermost, lines>> of the listing blocks with two lines or more."""
    lined = F.transform(
        html_blocks(html),
        lambda b: F.struct(
            b["block_no"].alias("block_no"),
            b["is_outermost"].alias("is_outermost"),
            _filled_lines(b["text"]).alias("lines"),
        ),
    )
    return F.filter(lined, lambda b: F.size(b["lines"]) >= 2)


def _block_record(e: Column) -> Column:
    lines = e["lines"]
    return _listing_record(e["block_no"], 2, F.get(lines, F.lit(0)), F.slice(lines, 2, F.size(lines)), "blocks")


def block_businesses(pages: DataFrame) -> DataFrame:
    """Listings in div, article and section elements whose class names a listing.

    Only pages that mention such a class reach the parser. Nested blocks repeat their text and are
    told apart by is_outermost.
    """
    html = F.col("html")
    rows = exploded(pages.where(_has_blocks(html)), block_array(html), "page_id")
    outer = rows.select("page_id", "e", F.col("e.is_outermost").alias("is_outermost"))
    return _rows(outer, _block_record(F.col("e")), "is_outermost")


def directory_businesses(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Line listings, then block listings, without de-duplication."""
    blocks = block_businesses(pages).drop("is_outermost").withColumn("part", F.lit(2))
    return line_businesses(texts).withColumn("part", F.lit(1)).unionByName(blocks)


# --- map markers ------------------------------------------------------------------------------

_NEXT_POINT = r"[\d.-]+\s*\|\s*[\d.-]+\s*\|"
# A name ends where the next point starts, even on the same line.
MARKER = fixed.POINT + rf"([^\r\n|]+?)(?=\s*{_NEXT_POINT}|[\r\n]|\s*\z)"
INFO_MARKER = fixed.POINT + rf"([^\r\n]+?)(?=\s*{_NEXT_POINT}|[\r\n]|\z)"


def readable_text(html: Column) -> Column:
    """Text of a page as figures, contacts and listings read it: shortcodes gone, links and headings marked."""
    return forms.link_text(forms.drop_shortcodes(html))


def marker_array(html: Column) -> Column:
    """array<struct<lat, lon, name>> of a page's map, entries without usable numbers dropped."""
    entries = every(F.regexp_extract(html, fixed.MARKER_LIST, 1), MARKER)
    parsed = F.transform(
        entries,
        lambda e: F.struct(
            F.regexp_extract(e, MARKER, 1).try_cast("double").alias("lat"),
            F.regexp_extract(e, MARKER, 2).try_cast("double").alias("lon"),
            squash(X.decode_entities(F.regexp_extract(e, MARKER, 3))).alias("name"),
        ),
    )
    return F.filter(parsed, lambda m: m["lat"].isNotNull() & m["lon"].isNotNull() & (m["name"] != ""))


def _mapped(pages: DataFrame) -> DataFrame:
    """Pages with a map widget; the plain test spares all others the patterns."""
    return pages.where(F.col("html").contains("map_markers="))


def map_markers(pages: DataFrame) -> DataFrame:
    return exploded(_mapped(pages), marker_array(F.col("html")), "page_id").select(
        "page_id", "pos", F.col("e.name").alias("name"), F.col("e.lat").alias("lat"), F.col("e.lon").alias("lon")
    )


#: Put into a text where the next line starts with a letter: there the section of a name ends. No page holds it.
SECTION_END = "\ue000"


#: Up to so many letters (names x letters of the text) are searched name by name; more go through an index of the names.
SEARCHED = 20_000_000
#: Letters in which a text and the names are looked at first, and in one piece of it.
GRAM, UNIT = 8, 256


def _sections_by_search(names: Column, marked: Column, small: Column) -> Column:
    """Text from each lowered name on, up to the next mark; NULL if the name is absent. small: the lowered text.

    Two searches in the text as it lies in memory and one cut for a name; nothing is decoded.
    """

    def cut(at: Column) -> Column:
        end = F.position(F.lit(SECTION_END), marked, at)
        return F.when(at > 0, F.when(end > 0, F.substr(marked, at, end - at)).otherwise(F.substr(marked, at)))

    return F.transform(names, lambda name: let(F.instr(small, name), cut))


def _sections_by_index(names: Column, marked: Column, small: Column) -> Column:
    """The same in one pass over the text, whatever the number of names.

    A name holds no line break, so it lies between two marks. Each place there is looked up by its first letters in an
    index of the names' beginnings, and where they fit, by the lengths that names have.
    """
    entry = lambda key, value: F.struct(key.alias("key"), value.cast("int").alias("value"))

    def tables(size: Column) -> Column:
        return F.struct(
            size["gram"].alias("gram"),
            size["unit"].alias("unit"),
            F.array_distinct(F.transform(names, lambda n: F.length(n))).alias("lengths"),
            lookup.indexed(F.transform(names, lambda n: entry(F.substr(n, F.lit(1), size["gram"]), F.lit(0)))).alias("begins"),
            lookup.indexed(F.transform(names, lambda n: entry(n, F.lit(0)))).alias("names"),
            F.split(marked, SECTION_END, -1).alias("parts"),
        )

    def hits(t: Column) -> Column:
        """array<struct<key, part, at>> of the names found, in text order."""

        def in_unit(unit: Column, begin: Column, own: Column, part: Column) -> Column:
            fits = lambda i: lookup.found(t["begins"], F.substr(unit, i, t["gram"])).isNotNull()

            def at(i: Column) -> Column:
                pieces = F.transform(t["lengths"], lambda n: F.substr(unit, i, n))
                held = F.filter(pieces, lambda x: lookup.found(t["names"], x).isNotNull())
                return F.transform(held, lambda x: F.struct(x.alias("key"), part.alias("part"), (begin + i).alias("at")))

            return F.flatten(F.transform(F.filter(F.sequence(F.lit(1), F.length(own)), fits), at))

        def in_part(low: Column, part: Column) -> Column:
            cut = F.regexp_extract_all(low, F.concat(F.lit("(?s).{1,"), t["unit"], F.lit("}")), F.lit(0))

            def read(units: Column) -> Column:
                # A name may reach into the next unit, and no further.
                wide = lambda own, k: F.concat(own, F.coalesce(F.get(units, k + 1), F.lit("")))
                return F.flatten(
                    F.transform(units, lambda own, k: let(wide(own, k), lambda unit: in_unit(unit, k * t["unit"], own, part)))
                )

            return let(cut, read)

        return F.flatten(F.transform(F.split(small, SECTION_END, -1), in_part))

    def sections(t: Column, found: Column) -> Column:
        def section(name: Column, first_hits: Column) -> Column:
            hit = F.get(found, lookup.found(first_hits, name))
            return let(hit, lambda h: F.when(h.isNotNull(), F.substr(F.get(t["parts"], h["part"]), h["at"])))

        firsts = lookup.indexed(F.transform(found, lambda h, k: entry(h["key"], k)))
        return let(firsts, lambda first_hits: F.transform(names, lambda name: section(name, first_hits)))

    lengths = F.transform(names, lambda n: F.length(n))
    size = F.struct(
        F.least(F.lit(GRAM), F.array_min(lengths)).alias("gram"), F.greatest(F.lit(UNIT), F.array_max(lengths)).alias("unit")
    )
    return let(let(size, tables), lambda t: let(hits(t), lambda found: sections(t, found)))


def _sections_at(markers: Column, marked: Column, small: Column) -> Column:
    def of(names: Column) -> Column:
        few = F.size(names).cast("long") * F.length(small) <= SEARCHED
        return F.when(few, _sections_by_search(names, marked, small)).otherwise(_sections_by_index(names, marked, small))

    return let(F.transform(markers, lambda m: F.lower(m["name"])), of)


def _marked(text: Column) -> Column:
    """The text with a mark before each line that starts with a letter and is not the last."""
    plain = F.replace(text, F.lit(SECTION_END), F.lit(""))
    return F.regexp_replace(plain, r"(\n\s*+)(?=[A-Za-z][^\n]*+\n)", SECTION_END + "$1")


def detail_array(markers: Column, text: Column) -> Column:
    """Marker businesses with what the page's text says next to their names.

    A city match alone would hide the street, so the form with a street is tried first.
    """

    def fields(marker: Column, s: Column) -> Column:
        street = F.regexp_extract(s, fixed.STREET_CITY_STATE_ZIP, 0)
        return let(street, lambda full: record(marker, s, full))

    def record(marker: Column, s: Column, full: Column) -> Column:
        def part(in_street: int, in_city: int | None) -> Column:
            with_street = F.regexp_extract(full, fixed.STREET_CITY_STATE_ZIP, in_street)
            city_only = F.lit("") if in_city is None else F.regexp_extract(s, fixed.CITY_STATE_ZIP, in_city)
            return F.nullif(strip(F.when(full != "", with_street).otherwise(city_only)), F.lit(""))

        return F.struct(
            marker["name"].alias("name"),
            marker["lat"].alias("lat"),
            marker["lon"].alias("lon"),
            first(s, fixed.DASHED_PHONE).alias("phone"),
            first(s, fixed.WEBSITE_LINE, 1).alias("website"),
            F.nullif(F.regexp_extract(s, fixed.EMAIL, 0), F.lit("")).alias("email"),
            part(1, None).alias("street"),
            part(2, 1).alias("city"),
            part(3, 2).alias("state"),
            part(4, 3).alias("zip_code"),
            F.array_compact(
                F.array(*[F.when(s.contains(label), F.lit(label)) for label in fixed.DETAIL_SERVICES])
            ).alias("services"),
        )

    def details(found: Column) -> Column:
        return F.transform(markers, lambda m, i: let(F.get(found, i), lambda s: fields(m, s)))

    # Ends are marked and letters lowered once for all markers of the page.
    return let(
        _marked(text), lambda marked: let(F.lower(marked), lambda small: let(_sections_at(markers, marked, small), details))
    )


def with_markers(pages: DataFrame, markers: str = "markers", text: str = "text", where: Column | None = None) -> DataFrame:
    """pages(page_id, ..., html) with arrays 'markers' and readable 'text'; NULL where the condition does not hold.

    Markers come from the HTML, before shortcodes are cleaned away and take the map with them.
    """
    html = F.col("html")
    found = {markers: marker_array(html), text: readable_text(html)}
    return pages.withColumns({name: c if where is None else F.when(where, c) for name, c in found.items()})


def business_details(pages: DataFrame) -> DataFrame:
    """One row per marker with phone, website, e-mail, address and services found at its name."""
    read = with_markers(_mapped(pages).select("page_id", "html")).select("page_id", "markers", "text")
    return exploded(read, detail_array(F.col("markers"), F.col("text")), "page_id").select("page_id", "pos", "e.*")


def _detail_record(d: Column, pos: Column) -> Column:
    """A marker business in the shape all routes share."""
    place = F.concat_ws(", ", d["street"], d["city"], F.concat_ws(" ", d["state"], d["zip_code"]))
    return _record(
        pos,
        name=d["name"],
        address=F.when(d["state"].isNotNull(), place),
        phone=d["phone"],
        website_url=d["website"],
        email=d["email"],
        lat=d["lat"],
        lon=d["lon"],
        services=d["services"],
        source=F.lit("markers"),
    )


def listing_entries(details: Column) -> Column:
    """Marker businesses as the JSON block of a page's text names their fields; what is not there is left out."""

    def entry(d: Column) -> Column:
        address = F.struct(*[d[c].alias(c) for c in ("street", "city", "state", "zip_code")])
        return F.struct(
            d["name"].alias("name"),
            F.struct(d["lat"].alias("latitude"), d["lon"].alias("longitude")).alias("coordinates"),
            *[d[c].alias(c) for c in ("phone", "website", "email")],
            F.when(d["state"].isNotNull(), address).alias("address"),
            F.when(F.size(d["services"]) > 0, d["services"]).alias("services"),
        )

    return F.transform(details, entry)


# --- raw directory pages ----------------------------------------------------------------------


def map_entry_array(text: Column) -> Column:
    """array<struct<pos, lat, lon, info, parts>> of the map widget of a raw directory text."""
    quoted = F.concat(F.regexp_extract(text, fixed.QUOTED_MARKER_LIST, 1), F.regexp_extract(text, fixed.QUOTED_MARKER_LIST, 2))

    def entry(marker: Column, i: Column) -> Column:
        info = squash(X.decode_entities(F.regexp_extract(marker, INFO_MARKER, 3)))
        return let(
            info,
            lambda text: F.struct(
                i.alias("pos"),
                F.regexp_extract(marker, INFO_MARKER, 1).alias("lat"),
                F.regexp_extract(marker, INFO_MARKER, 2).alias("lon"),
                text.alias("info"),
                F.filter(
                    F.transform(F.split(text, r"<br\s*/?>\s*", -1), lambda p: squash(X.decode_entities(p))),
                    lambda p: p != "",
                ).alias("parts"),
            ),
        )

    return F.filter(
        F.transform(every(quoted, INFO_MARKER), entry),
        lambda e: (F.length(e["info"]) >= 10) & (F.size(e["parts"]) > 0),
    )


def _map_record(e: Column) -> Column:
    def kind(line: Column) -> Column:
        return (
            F.when(line.rlike(fixed.PAGE_PHONES[0]), "phone")
            .when(line.rlike(fixed.MAP_STREET), "street")
            .when(line.rlike(fixed.MAP_CITY), "city")
            .otherwise("other")
        )

    def read(rest: Column) -> Column:
        places = F.filter(rest, lambda x: x["kind"].isin("street", "city"))
        # The first place line starts the address; after it only city lines are added.
        wanted = let(places, lambda found: F.filter(found, lambda x, i: (i == 0) | (x["kind"] == "city")))
        phones = F.filter(rest, lambda x: x["kind"] == "phone")
        point = F.concat_ws(",", e["lat"], e["lon"])
        lat, lon = e["lat"].try_cast("double"), e["lon"].try_cast("double")
        return _record(
            e["pos"],
            2,
            name=F.get(e["parts"], F.lit(0)),
            address=F.array_join(F.transform(wanted, lambda x: x["line"]), ", "),
            address_url=F.concat(F.lit(fixed.MAP_QUERY), point),
            phone=F.coalesce(F.try_element_at(phones, F.lit(-1))["line"], F.lit("")),
            website_url=F.lit(""),
            lat=lat,
            lon=lon,
            services=service_labels("map", e["info"], default=True),
            extra_locations=F.array(F.struct(point.alias("name"), lat.alias("lat"), lon.alias("lon"))),
            source=F.lit("map_coordinates"),
        )

    lines = F.slice(e["parts"], 2, F.size(e["parts"]))
    return let(F.transform(lines, lambda p: F.struct(kind(p).alias("kind"), p.alias("line"))), read)


def map_businesses(texts: DataFrame) -> DataFrame:
    """Businesses of the map widget in raw directory texts(page_id, text)."""
    text = F.col("text")
    return _rows(exploded(texts.where(text.contains("map_markers=")), map_entry_array(text), "page_id"), _map_record(F.col("e")))


def table_row_array(text: Column) -> Column:
    """array<struct<pos, cells>> of the table-like rows that hold three cells or more and a phone."""

    def cells(row: Column) -> Column:
        found = F.transform(every(row, fixed.TABLE_CELL, 1), lambda c: squash(X.decode_entities(c)))
        return F.filter(found, lambda c: c != "")

    def listed(row: Column, i: Column) -> Column:
        likely = ~row.contains("divider") & (F.length(strip(row)) >= 100)
        return F.struct(i.alias("pos"), F.when(likely, cells(row)).alias("cells"))

    return F.filter(
        F.transform(every(X.upto_last(text, r"\[/vc_row_inner\]"), fixed.TABLE_ROW, 1), listed),
        lambda r: (F.size(r["cells"]) >= 3) & F.exists(r["cells"], lambda c: c.rlike(fixed.PAGE_PHONES[0])),
    )


def _table_record(e: Column) -> Column:
    cells = e["cells"]
    address = F.get(cells, F.lit(1))
    labels = F.flatten(F.transform(F.slice(cells, 4, F.size(cells)), lambda c: service_labels("cell", c)))
    query = F.replace(F.replace(address, F.lit(" "), F.lit("+")), F.lit(","), F.lit("%2C"))
    return _record(
        e["pos"],
        name=F.get(cells, F.lit(0)),
        address=address,
        address_url=F.concat(F.lit(fixed.MAP_QUERY), query),
        phone=F.get(cells, F.lit(2)),
        website_url=F.lit(""),
        services=let(labels, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit(fixed.DEFAULT_SERVICE)))),
        source=F.lit("table_format"),
    )


def table_businesses(texts: DataFrame) -> DataFrame:
    """Businesses of table-like rows in raw directory texts: name, address, phone, then services."""
    text = F.col("text")
    return _rows(exploded(texts.where(text.contains("[vc_row_inner")), table_row_array(text), "page_id"), _table_record(F.col("e")))


def _joined(*arrays: Column) -> Column:
    """Arrays one after another; NULL counts as empty."""
    return F.flatten(F.array_compact(F.array(*arrays)))


def _merged(table_rows: Column, map_entries: Column) -> Column:
    """Table, then map businesses of one page, each name once: the first of its name stays."""

    def firsts(found: Column) -> Column:
        names = F.transform(found, lambda b, i: F.struct(F.lower(strip(b["name"])).alias("name"), i.alias("i")))
        return let(F.array_sort(names), lambda named: chosen(found, named))

    def chosen(found: Column, named: Column) -> Column:
        first_of_name = F.filter(named, lambda x, k: (k == 0) | ~x["name"].eqNullSafe(F.get(named, k - 1)["name"]))
        return F.transform(F.array_sort(F.transform(first_of_name, lambda x: x["i"])), lambda i: F.get(found, i))

    return let(_joined(F.transform(table_rows, _table_record), F.transform(map_entries, _map_record)), firsts)


def dedupe_businesses(businesses: DataFrame, scope: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One business per name within a scope: the lowest priority, then the lowest position, wins.

    Only the first row of a group is wanted, so each task drops the others before the shuffle and a
    name that fills a third of the table costs no more than a rare one.
    """
    keyed = businesses.withColumn("_name", F.lower(strip(F.col("name"))))
    order = W.partitionBy(*scope, "_name").orderBy("priority", "page_id", "pos")
    return keyed.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == 1).drop("_name", "_nth")


def merged_businesses(texts: DataFrame, scope: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Table and map businesses of raw directory texts, the table's version first.

    scope: the columns of texts within which a name counts once, such as the page or the site. Within a page the names
    are compared in its row; a wider scope shuffles by scope and name.
    """
    text = F.col("text")
    rows = F.when(text.contains("[vc_row_inner"), table_row_array(text))
    entries = F.when(text.contains("map_markers="), map_entry_array(text))
    listed = texts.where(text.contains("[vc_row_inner") | text.contains("map_markers="))
    keys = list(dict.fromkeys(["page_id", *scope]))
    found = exploded(listed, _merged(rows, entries), *keys).select(*keys, "e.*").withColumnRenamed("part", "priority")
    return found if keys == ["page_id"] else dedupe_businesses(found, scope)


def source_counts(businesses: DataFrame) -> DataFrame:
    return businesses.groupBy("source").agg(F.count("*").alias("businesses"))


# --- shortcode sections -----------------------------------------------------------------------

def _three_entities(text: Column) -> Column:
    for entity, char in (("&amp;", "&"), ("&#8217;", "'"), ("&#8243;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def sections(pages: DataFrame) -> DataFrame:
    """Text sections of shortcode pages in page order; positions count empty sections too."""
    return exploded(pages, _section_array(F.col("html")), "page_id").select(
        "page_id", "pos", F.col("e.raw").alias("raw"), F.col("e.lines").alias("lines")
    )


def _section_bodies(html: Column) -> Column:
    return every(X.upto_last(html, r"\[/vc_column_text\]"), fixed.TEXT_SECTION, 1)


def _section_array(html: Column) -> Column:
    """array<struct<pos, raw, lines>>."""
    return F.transform(
        _section_bodies(html),
        lambda raw, i: F.struct(
            i.alias("pos"), raw.alias("raw"), _filled_lines(_three_entities(X.drop_tags(raw))).alias("lines")
        ),
    )


def _filled_sections(html: Column) -> Column:
    return F.filter(_section_array(html), lambda s: F.size(s["lines"]) > 0)


def _section_kind(line: Column, second: Column) -> Column:
    lower = F.lower(line)
    address = (
        lower.rlike("^" + fixed.STREET_LINE.removeprefix(r"\b"))
        | line.rlike(fixed.STATE_ZIP)
        | F.coalesce(second.rlike(fixed.STATE_ZIP), F.lit(False))
    )
    return (
        F.when(lower == "website", "website")
        .when(X.has_any(lower, fixed.LABEL_WORDS), "label")
        .when(line.rlike(fixed.PHONE_ONLY), "phone")
        .when(address, "address")
        .when(line.rlike(fixed.COORDINATES), "coordinates")
        .otherwise("name")
    )


#: A letter for each kind of section, so that a page's sections are one string.
SECTION_LETTERS = {"website": "w", "label": "l", "phone": "p", "address": "a", "coordinates": "c", "name": "n"}


def _website(raw: Column) -> Column:
    links = [first(raw, pattern, 1) for pattern in fixed.HREFS]
    return F.coalesce(*[F.when(link.startswith("http") & ~link.contains("google.com/maps"), link) for link in links])


def _started(filled: Column, start_marker: str | None) -> Column:
    """Sections from the first on whose first line holds the marker; all of them where none does."""
    if start_marker is None:
        return filled

    def after(s: Column) -> Column:
        is_start = lambda x: F.lower(F.get(x["lines"], F.lit(0))).contains(start_marker.lower())
        begin = F.array_min(F.array_compact(F.transform(s, lambda x, i: F.when(is_start(x), i))))
        return F.slice(s, F.coalesce(begin, F.lit(0)) + 1, F.size(s))

    return let(filled, after)


def section_business_array(filled: Column, start_marker: str | None = None) -> Column:
    """Businesses of the filled sections of a page: a name section opens one, the next sections describe it.

    A "Website" label below a name takes the link of the section after it, which then counts for nothing else; in a run
    of such labels every second one is taken by the one before. The sections' kinds are read as a string of letters, in
    which a label and what it takes are one match.
    """

    def letters(s: Column) -> Column:
        kinds = F.transform(s, lambda x: _section_kind(F.get(x["lines"], F.lit(0)), F.get(x["lines"], F.lit(1))))
        letter = F.create_map(*[F.lit(x) for pair in SECTION_LETTERS.items() for x in pair])
        return F.array_join(F.transform(kinds, lambda kind: F.element_at(letter, kind)), "")

    def told(s: Column, line: Column) -> Column:
        head = F.regexp_extract(line, "^[^n]*", 0)
        marks = F.concat(head, F.regexp_replace(F.substr(line, F.length(head) + 1), "w.", "wt"))
        return let(F.split(marks, ""), lambda m: let(facts(s, m), lambda f: businesses(f, m)))

    def facts(s: Column, marks: Column) -> Column:
        def fact(x: Column, i: Column) -> Column:
            mark, lines = F.get(marks, i), x["lines"]
            return F.struct(
                mark.alias("mark"),
                x["pos"].alias("pos"),
                F.when(mark == "n", full_name(lines))
                .when(mark == "p", F.get(lines, F.lit(0)))
                .when(mark == "a", F.array_join(lines, ", "))
                .when(mark == "w", _website(F.get(s, i + 1)["raw"]))
                .alias("value"),
                F.when(mark == "a", first(x["raw"], fixed.MAP_ANCHOR, 1)).alias("url"),
            )

        return F.transform(s, fact)

    def full_name(lines: Column) -> Column:
        second = F.get(lines, F.lit(1))
        tail = (F.length(second) < 20) & (second.startswith("&") | F.lower(second).isin(*fixed.NAME_TAILS))
        return F.concat_ws(" ", F.get(lines, F.lit(0)), F.when(tail, second))

    def businesses(f: Column, marks: Column) -> Column:
        heads = F.array_compact(F.transform(marks, lambda mark, i: F.when(mark == "n", i)))
        return let(heads, lambda h: F.transform(h, lambda at, k: record(f, at, F.coalesce(F.get(h, k + 1), F.size(f)))))

    def record(f: Column, begin: Column, end: Column) -> Column:
        def last(part: Column, mark: str, field: str = "value") -> Column:
            held = F.filter(part, lambda x: (x["mark"] == mark) & x[field].isNotNull())
            return F.coalesce(F.try_element_at(held, F.lit(-1))[field], F.lit(""))

        def read(part: Column) -> Column:
            name = F.get(part, F.lit(0))["value"]
            return _record(
                F.get(part, F.lit(0))["pos"],
                name=name,
                address=last(part, "a"),
                address_url=last(part, "a", "url"),
                phone=last(part, "p"),
                website_url=last(part, "w"),
                services=service_labels("name", name),
                source=F.lit("sections"),
            )

        return let(F.slice(f, begin + 1, end - begin), read)

    return let(_started(filled, start_marker), lambda s: let(letters(s), lambda line: told(s, line)))


def _coded(pages: DataFrame) -> DataFrame:
    """Pages with text sections; the plain test spares all others the patterns."""
    return pages.where(F.col("html").contains("[vc_column_text"))


def section_businesses(pages: DataFrame, start_marker: str | None = None) -> DataFrame:
    """Businesses of shortcode sections, one row each. start_marker names text in the first line of the first listing."""
    listed = section_business_array(_filled_sections(F.col("html")), start_marker)
    return exploded(_coded(pages), listed, "page_id").select("page_id", "e.*").drop("part")


def point_array(html: Column) -> Column:
    """array<struct<pos, lat, lon, name>>: the lines of three parts or more of the first section that holds coordinates."""
    held = F.filter(_section_bodies(html), lambda s: s.rlike(fixed.COORDINATES))
    none = F.array().cast("array<string>")
    lines = F.when(F.size(held) > 0, F.split(F.get(held, F.lit(0)), "<br />", -1)).otherwise(none)
    parts = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), F.split(line, r"\|", -1).alias("p")))

    def point(x: Column) -> Column:
        return F.struct(
            x["pos"].alias("pos"),
            strip(F.get(x["p"], F.lit(0))).alias("lat"),
            strip(F.get(x["p"], F.lit(1))).alias("lon"),
            _three_entities(strip(F.get(x["p"], F.lit(2)))).alias("name"),
        )

    return F.transform(F.filter(parts, lambda x: F.size(x["p"]) >= 3), point)


def marker_lines(pages: DataFrame) -> DataFrame:
    """Coordinate lines (lat | lon | name) of the first section of a page that holds any."""
    return exploded(_coded(pages), point_array(F.col("html")), "page_id").select("page_id", "e.*")


# --- matching by name -------------------------------------------------------------------------

#: Up to so many pairs of a page's points and businesses are compared one by one; more go through an index.
PAIRS = 100_000


def _known(businesses: Column) -> Column:
    """array<struct<pos, text, words>>: lowered names, and their longer words."""

    def known(b: Column) -> Column:
        base = b["name"]
        for noise in ("&", ",", "LLC", "Inc"):
            base = F.replace(base, F.lit(noise), F.lit(""))
        words = F.filter(X.words(F.lower(base)), lambda w: F.length(w) > 3)
        return F.struct(b["pos"].cast("int").alias("pos"), F.lower(b["name"]).alias("text"), words.alias("words"))

    return F.transform(businesses, known)


def _hits_by_pair(texts: Column, known: Column) -> Column:
    """array<struct<existing, extra>> for each text: the lowest pos of a business of each kind."""

    def lowest(text: Column, test: Callable[[Column, Column], Column]) -> Column:
        return F.array_min(F.transform(F.filter(known, lambda b: test(text, b)), lambda b: b["pos"]))

    return F.transform(
        texts,
        lambda t: F.struct(
            lowest(t, lambda t, b: t.contains(b["text"]) | b["text"].contains(t)).alias("existing"),
            lowest(t, lambda t, b: F.exists(b["words"], lambda w: t.contains(w))).alias("extra"),
        ),
    )


def _hits_by_index(texts: Column, known: Column) -> Column:
    """The same through tables of names, words and pieces of names: work grows with the lengths of both lists.

    The lengths that occur are few, whatever the number of names.
    """
    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    lengths = lambda array: F.array_distinct(F.transform(array, lambda x: F.length(x)))
    names = F.transform(known, lambda b: entry(b["text"], b["pos"]))
    words = F.flatten(F.transform(known, lambda b: F.transform(b["words"], lambda w: entry(w, b["pos"]))))

    def inside(text: Column, index: Column, sizes: Column) -> Column:
        """The lowest value of a key that stands in the text."""
        return F.array_min(F.transform(lookup.substrings(text, sizes), lambda piece: lookup.found(index, piece)))

    def pieces(wanted: Column, sizes: Column) -> Column:
        """Pieces of the names that are texts, with the name's pos."""
        of_one = lambda b: F.transform(
            F.filter(lookup.substrings(b["text"], sizes), lambda piece: lookup.found(wanted, piece).isNotNull()), lambda piece: entry(piece, b["pos"])
        )
        return F.flatten(F.transform(known, of_one))

    def hits(index: Column, around: Column) -> Column:
        return F.transform(
            texts,
            lambda t: F.struct(
                F.least(inside(t, index["names"], index["name_sizes"]), lookup.found(around, t)).alias("existing"),
                inside(t, index["words"], index["word_sizes"]).alias("extra"),
            ),
        )

    tables = F.struct(
        lookup.indexed(names).alias("names"),
        lookup.indexed(words).alias("words"),
        lookup.indexed(F.transform(texts, lambda t: entry(t, F.lit(0)))).alias("wanted"),
        lengths(F.transform(known, lambda b: b["text"])).alias("name_sizes"),
        lengths(F.flatten(F.transform(known, lambda b: b["words"]))).alias("word_sizes"),
        lengths(texts).alias("text_sizes"),
    )
    around = lambda index: lookup.indexed(pieces(index["wanted"], index["text_sizes"]))
    return let(tables, lambda index: let(around(index), lambda held: hits(index, held)))


def match_array(points: Column, businesses: Column) -> Column:
    """Points with outcome and business_pos: how each relates to the businesses of its page.

    outcome is 'existing' where one name holds the other, 'extra' where a longer word of a
    business name stands in the point's name, else 'new'; business_pos names the first such business.
    Points are matched against the given businesses only, so the result does not depend on order.
    """

    def matched(points: Column, hits: Column) -> Column:
        def point(p: Column, i: Column) -> Column:
            hit = F.get(hits, i)
            return F.struct(
                *[p[c].alias(c) for c in ("pos", "name", "lat", "lon")],
                F.when(hit["existing"].isNotNull(), "existing").when(hit["extra"].isNotNull(), "extra").otherwise("new").alias("outcome"),
                F.coalesce(hit["existing"], hit["extra"]).alias("business_pos"),
            )

        return F.transform(points, point)

    def hits(texts: Column, known: Column) -> Column:
        few = F.size(texts).cast("long") * F.size(known) <= PAIRS
        return F.when(few, _hits_by_pair(texts, known)).otherwise(_hits_by_index(texts, known))

    def of(points: Column) -> Column:
        texts = F.transform(points, lambda p: F.lower(p["name"]))
        found_hits = let(texts, lambda t: let(_known(businesses), lambda known: hits(t, known)))
        return let(found_hits, lambda h: matched(points, h))

    return let(points, of)


def _with_matches(pages: DataFrame, start_marker: str | None) -> DataFrame:
    """Shortcode pages with '_listed', their section businesses, and '_matched', their points.

    Column by column, for the analyzer goes through a hundred levels of nested functions and no more.
    """
    html = F.col("html")
    read = _coded(pages).select("page_id", _filled_sections(html).alias("_sections"), point_array(html).alias("_points"))
    listed = read.withColumn("_listed", section_business_array(F.col("_sections"), start_marker))
    return listed.withColumn("_matched", match_array(F.col("_points"), F.col("_listed")))


def match_points(pages: DataFrame, start_marker: str | None = None) -> DataFrame:
    """The map points of shortcode pages with outcome and business_pos (match_array), matched against the page's sections."""
    read = _with_matches(pages, start_marker)
    return exploded(read, "_matched", "page_id").select("page_id", "e.*")


def extra_locations(matched: DataFrame) -> DataFrame:
    """Further places of known businesses, one row each."""
    rows = matched.where(F.col("outcome") == "extra")
    return rows.select("page_id", "business_pos", "pos", "name", F.concat_ws(", ", "lat", "lon").alias("coordinates"))


def _point_record(m: Column) -> Column:
    return _record(
        m["pos"],
        2,
        name=m["name"],
        address=F.concat(F.lit("Coordinates: "), F.concat_ws(", ", m["lat"], m["lon"])),
        address_url=F.lit(""),
        phone=F.lit(""),
        website_url=F.lit(""),
        lat=m["lat"].try_cast("double"),
        lon=m["lon"].try_cast("double"),
        services=service_labels("name", m["name"]),
        source=F.lit("points"),
    )


def point_businesses(matched: DataFrame) -> DataFrame:
    """Points that stand for no known business, as businesses of their own."""
    new = matched.where(F.col("outcome") == "new")
    return _rows(new.select("page_id", F.struct("pos", "name", "lat", "lon").alias("e")), _point_record(F.col("e")))


def shortcode_array(listed: Column, matched: Column) -> Column:
    """Section businesses with their extra locations, then the businesses only the map knows."""

    def both(listed: Column, matched: Column) -> Column:
        extra = F.filter(matched, lambda m: m["outcome"] == "extra")
        placed = F.transform(
            extra,
            lambda m: F.struct(
                m["business_pos"].alias("business_pos"),
                m["pos"].alias("pos"),
                F.struct(
                    m["name"].alias("name"), m["lat"].try_cast("double").alias("lat"), m["lon"].try_cast("double").alias("lon")
                ).alias("place"),
            ),
        )
        new = F.filter(matched, lambda m: m["outcome"] == "new")
        return F.concat(
            let(F.array_sort(placed), lambda places: with_places(listed, places)), F.transform(new, _point_record)
        )

    def with_places(listed: Column, places: Column) -> Column:
        # Places lie sorted by business: one look-up finds where a business's own begin, the next head where they end.
        heads = F.filter(
            F.transform(places, lambda x, i: F.struct(x["business_pos"].alias("of"), i.alias("i"))),
            lambda x, _: (x["i"] == 0) | (F.get(places, x["i"] - 1)["business_pos"] != x["of"]),
        )
        return let(heads, lambda h: let(keyed(h), lambda index: F.transform(listed, lambda b: placed(b, places, h, index))))

    def keyed(heads: Column) -> Column:
        return lookup.indexed(F.transform(heads, lambda x, k: F.struct(x["of"].cast("string").alias("key"), k.alias("value"))))

    def placed(b: Column, places: Column, heads: Column, index: Column) -> Column:
        def cut(k: Column) -> Column:
            begin = F.get(heads, k)["i"]
            end = F.coalesce(F.get(heads, k + 1)["i"], F.size(places))
            return F.when(k.isNotNull(), F.transform(F.slice(places, begin + 1, end - begin), lambda x: x["place"]))

        return b.withField("extra_locations", let(lookup.found(index, b["pos"].cast("string")), cut).cast(EXTRA))

    return let(F.struct(listed.alias("_listed"), matched.alias("_matched")), lambda x: both(x["_listed"], x["_matched"]))


def shortcode_businesses(pages: DataFrame, start_marker: str | None = None) -> DataFrame:
    """Section businesses with their extra locations (part 1), and the businesses only the map knows (part 2)."""
    read = _with_matches(pages, start_marker)
    rows = exploded(read, shortcode_array(F.col("_listed"), F.col("_matched")), "page_id").select("page_id", "e.*")
    return rows.select("page_id", "pos", *BUSINESS, "part")


def with_listings(pages: DataFrame, start_marker: str | None = None) -> DataFrame:
    """pages(page_id, ..., html) with 'details' (map markers with what the text says), 'route' and 'businesses'.

    route numbers the first route that finds anything on a page: map markers with details, directory lines and blocks,
    table and map merge, shortcode sections. All of it comes from the page's row: no shuffle, no second reading, and the
    businesses may go on with the row. A column 'text' that the pages bring is taken for their readable text.
    """
    html = F.col("html")
    keep = [c for c in pages.columns if c not in ("details", "route", "businesses")]
    mapped, coded = html.contains("map_markers="), html.contains("[vc_column_text")
    text = F.col("text") if "text" in pages.columns else readable_text(html)
    read = pages.withColumns({"_markers": F.when(mapped, marker_array(html)), "_read": text})
    raw = read.select(
        *keep,
        F.when(mapped, detail_array(F.col("_markers"), F.col("_read"))).alias("details"),
        line_block_array(F.col("_read")).alias("_lines"),
        block_array(F.when(_has_blocks(html), html)).alias("_blocks"),
        F.when(mapped, map_entry_array(html)).alias("_entries"),
        F.when(html.contains("[vc_row_inner"), table_row_array(html)).alias("_rows"),
        F.when(coded, _filled_sections(html)).alias("_sections"),
        F.when(coded, point_array(html)).alias("_points"),
    )
    some = lambda name: F.coalesce(F.size(name), F.lit(0)) > 0
    route = (
        F.when(some("details"), 1)
        .when(some("_lines") | some("_blocks"), 2)
        .when(some("_entries") | some("_rows"), 3)
        .otherwise(4)
    )
    routes = {
        1: F.transform("details", _detail_record),
        2: _joined(F.transform("_lines", _line_record), F.transform("_blocks", _block_record)),
        3: _merged(F.col("_rows"), F.col("_entries")),
        4: shortcode_array(F.col("_listed"), F.col("_matched")),
    }
    found_by = F.when(F.col("route") == 1, routes[1])
    for number in (2, 3):
        found_by = found_by.when(F.col("route") == number, routes[number])
    # Column by column, as in _with_matches.
    listed = raw.withColumns({"route": route, "_listed": section_business_array(F.col("_sections"), start_marker)})
    matched = listed.withColumn("_matched", match_array(F.col("_points"), F.col("_listed")))
    return matched.select(*keep, "details", "route", found_by.otherwise(routes[4]).alias("businesses"))


def page_businesses(pages: DataFrame, start_marker: str | None = None) -> DataFrame:
    """The business listings of each page by its first route that finds any, one row each.

    Pages that with_listings has read are not read again.
    """
    listed = pages if "businesses" in pages.columns else with_listings(pages.select("page_id", "html"), start_marker)
    rows = exploded(listed, "businesses", "page_id", "route").select("page_id", "route", "e.*")
    return rows.select("page_id", "pos", *BUSINESS, "part", "route")
