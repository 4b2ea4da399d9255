from __future__ import annotations

import random
import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pageloom.operators import directory

LISTING = "ACME MARINE\n218-555-0123\n12 Oak Street\nElk, MN 56000\nBoat repair\nClosed"


def test_line_listing(texts):
    df = directory.line_businesses(texts(f"intro line\n{LISTING}\nBIG DOCK CO\n\n1 Elm Rd\nEly, MN 56001\n2 Elm Rd\n(218) 555-0199 or 218-555-0000", "no listing", None))
    assert rows(df, "page_id", "pos", "name", "address", "phone", "services", "other_info") == [
        (1, 0, "ACME MARINE", "12 Oak Street, Elk, MN 56000", "218-555-0123", ["Boat repair"], ["Closed"]),
        (1, 1, "BIG DOCK CO", "2 Elm Rd", "(218) 555-0199", [], []),
    ]


def test_zip_lines_alone_make_an_address(texts):
    df = directory.line_businesses(texts("ACME CO\nElk, MN 56000\nEly, MN 56001"))
    assert rows(df, "address") == [("Elk, MN 56000, Ely, MN 56001",)]


def test_headers_exclude_phones_and_streets(texts):
    df = directory.line_businesses(texts("CALL 218-555-0123\n12 OAK STREET\nONE\nTWO WORDS"))
    assert rows(df, "name") == [("TWO WORDS",)]


def test_blocks_repeat_nested_text(pages):
    html = '<div class="listing">\n<article class="Card">Acme\n218-555-0123<script>var a\n</script></article>\nmore\n</div><div class="x">a\nb</div>'
    df = directory.block_businesses(pages(html, "<p>", None))
    assert rows(df, "pos", "name", "phone", "other_info", "is_outermost") == [
        (0, "Acme", "218-555-0123", ["more"], True),
        (1, "Acme", "218-555-0123", [], False),
    ]


def test_blocks_need_two_lines_and_survive_bad_nesting(pages):
    df = directory.block_businesses(pages('<div class=item>one</div>', '<div class="item"><b>A\nB</div></i>tail\nC'))
    assert rows(df, "page_id", "name", "other_info") == [(2, "A", ["B"])]


def test_unclosed_blocks_end_where_the_next_opens():
    from pageloom.functions.blocks import _parse

    card = '<div class="card">Shop {}\n218-555-0123\n'
    found = _parse("".join(card.format(i) for i in range(4_000)) + '<div class="card">a<p class="x">b</p></div>')
    assert [b["text"] for b in found[:2]] == ["Shop 0\n218-555-0123\n", "Shop 1\n218-555-0123\n"]
    assert found[-1]["text"] == "ab" and all(b["is_outermost"] for b in found)
    assert sum(len(b["text"]) for b in found) < 4_000 * 30
    nested = _parse('<div class="listing">x<div class="item">y<section class="card"></section></div>z</div><article class="item">w</article>')
    assert [(b["text"], b["is_outermost"]) for b in nested] == [("xyz", True), ("y", False), ("", False), ("w", True)]
    start = time.monotonic()
    _parse("<b>" * 100_000 + "</i>" * 100_000 + '<div class="card">' * 4_000 + "x</div>" * 4_000)
    assert time.monotonic() - start < 20


def test_map_markers(pages):
    df = directory.map_markers(
        pages('[nectar_gmap map_markers="1.5 | -2.5 | Shop\n1.2.3 | 4 | Bad\n3 | 4 | Joe&#8217;s &amp; Co 5 | 6 | Next"]', 'map_markers="7|8|Last"', "x")
    )
    assert rows(df, "page_id", "pos", "name", "lat", "lon") == [
        (1, 0, "Shop", 1.5, -2.5),
        (1, 1, "Joe’s & Co", 3.0, 4.0),
        (1, 2, "Next", 5.0, 6.0),
        (2, 0, "Last", 7.0, 8.0),
    ]


def test_details_prefer_the_street_form_and_end_at_the_next_heading(pages):
    html = (
        '[nectar_gmap map_markers="1 | 2 | Acme\n3 | 4 | Zed"]<p>about</p><p>acme</p>\n 12 Oak St, Elk, MN 56000 218-555-0123 '
        "Website | https://acme.test a@acme.test Docks &amp; Lifts, Trailers\nZed Shop\n 5 Ely, MN 56001\n"
    )
    got = {r.name: r for r in directory.business_details(pages(html)).collect()}
    acme, zed = got["Acme"], got["Zed"]
    assert (acme.street, acme.city, acme.state, acme.zip_code) == ("12 Oak St", "Elk", "MN", "56000")
    assert (acme.phone, acme.website, acme.email) == ("218-555-0123", "https://acme.test", "a@acme.test")
    assert acme.services == ["Docks & Lifts", "Trailers"]
    assert (zed.phone, zed.email, zed.city, zed.state) == (None, None, "Ely", "MN")


def test_table_rows(texts):
    cell = "[vc_column_text]{}[/vc_column_text]"
    row = lambda *cells: "[vc_row_inner]" + "".join(map(cell.format, cells)) + "[/vc_row_inner]"
    df = directory.table_businesses(
        texts(
            row("Acme", "1 Oak St, Elk", "218-555-0123", "Dock &amp; lift", "Trailers")
            + row("No phone", "an address long enough to pass the length test of the row", "none")
            + row("Bolt", "2 Oak St", "218 555.0123", "A website label in a row long enough to be read")
        )
    )
    assert rows(df, "pos", "name", "address_url", "services") == [
        (0, "Acme", "https://maps.google.com/?q=1+Oak+St%2C+Elk", ["docks & lifts", "trailers"]),
        (2, "Bolt", "https://maps.google.com/?q=2+Oak+St", ["docks & lifts"]),
    ]


def test_map_entries(texts):
    df = directory.map_businesses(
        texts(
            'map_markers="45.1 | -94.1 | Acme Docks<br>1 Oak St<br />2 Elm Ave<br>Elk, MN 56000<br>218-555-0123<br>218-555-0199\n'
            '45.2 | -94.2 | tiny\n45.3 | -94.3 | Transport Lift Co 46 | -95 | Second on a line"'
        )
    )
    assert rows(df, "name", "address", "phone", "services") == [
        ("Acme Docks", "1 Oak St, Elk, MN 56000", "218-555-0199", ["docks"]),
        ("Second on a line", "", "", ["docks & lifts"]),
        ("Transport Lift Co", "", "", ["lifts", "trailers"]),
    ]


def test_merge_prefers_the_table_and_is_idempotent(texts):
    table = "[vc_row_inner]" + "".join(
        f"[vc_column_text]{c}[/vc_column_text]" for c in ("Acme ", "12 Oak Street, Elk River", "218-555-0123", "Docks and everything else")
    ) + "[/vc_row_inner]"
    df = directory.merged_businesses(texts(table + 'map_markers="1 | 2 | acme<br>map version\n3 | 4 | Zed of the map"'))
    assert rows(df, "name", "source") == [("Acme", "table_format"), ("Zed of the map", "map_coordinates")]
    assert rows(directory.dedupe_businesses(df), "name") == rows(df, "name")
    assert rows(directory.source_counts(df)) == [("map_coordinates", 1), ("table_format", 1)]


def _sections(*bodies: str) -> str:
    return "".join(f"[vc_column_text]{b}[/vc_column_text]" for b in bodies)


def test_section_listing(pages):
    html = _sections(
        "Website", "Contact", "Acme Dock\n&amp; Lift", " ", '<a href="https://google.com/maps/1">1 Oak Street</a>\nElk, MN 56000', "218-555-0123",
        "Website", '<a href="https://acme.test">Visit</a>', "Email", "45.1 | -94.1", "Bolt Marine", "(218) 555-0199", "Website", "<a href='https://www.google.com/maps/x'>Bolt Site</a>",
    )
    df = directory.section_businesses(pages(html, "none"))
    assert rows(df, "name", "address", "address_url", "phone", "website_url", "services") == [
        ("Acme Dock & Lift", "1 Oak Street, Elk, MN 56000", "https://google.com/maps/1", "218-555-0123", "https://acme.test", ["docks & lifts"]),
        ("Bolt Marine", "", "", "(218) 555-0199", "", ["marine"]),
    ]


def test_a_label_taken_by_a_label_takes_nothing(pages):
    # The first label takes the second, so the third section is a business of its own.
    html = _sections("Acme", "Website", "Website", "Bolt", "Website", "<a href='http://bolt.test'>Cole</a>", "Dune")
    df = directory.section_businesses(pages(html).repartition(3))
    assert rows(df, "name", "website_url") == [("Acme", ""), ("Bolt", "http://bolt.test"), ("Dune", "")]


def test_start_marker_skips_what_comes_before(pages):
    html = _sections("Welcome", "Our list", "Acme", "218-555-0123")
    assert directory.section_businesses(pages(html)).count() == 3
    assert rows(directory.section_businesses(pages(html), "acme"), "name", "phone") == [("Acme", "218-555-0123")]


def test_points(pages):
    html = _sections("Acme Docks", "218-555-0123", "1.5 | -2.5 | Acme Docks LLC<br />3.5 | 4 | Acme North<br />5 | 6 | Zed<br />bad")
    page = pages(html)
    matched = directory.match_points(page)
    assert rows(matched, "name", "outcome") == [("Acme Docks LLC", "existing"), ("Acme North", "extra"), ("Zed", "new")]
    assert rows(directory.extra_locations(matched), "name", "coordinates") == [("Acme North", "3.5, 4")]
    both = directory.shortcode_businesses(page)
    assert rows(both, "part", "name", "address") == [(1, "Acme Docks", ""), (2, "Zed", "Coordinates: 5, 6")]
    extra = both.where("part = 1").first().extra_locations
    assert [(e.name, e.lat, e.lon) for e in extra] == [("Acme North", 3.5, 4.0)]


@pytest.mark.parametrize("pairs", [100_000, -1])
def test_matching_equals_brute_force(spark, monkeypatch, pairs):
    """One by one, and through the index."""
    monkeypatch.setattr(directory, "PAIRS", pairs)
    rng = random.Random(11)
    name = lambda: " ".join(rng.choice(["acme", "dock", "a", "north", "Lift", "LLC", "&", "bay, co", ""]) for _ in range(rng.randint(0, 3)))
    points = [(rng.randint(1, 3), i, name()) for i in range(120)]
    # Half of all businesses stand on one page.
    known = [(rng.choice([1, 1, 2, 3]), i, name() or "x") for i in range(60)]
    rows = [
        (page, [(i, n, "1", "2") for p, i, n in points if p == page], [(i, n) for p, i, n in known if p == page]) for page in (1, 2, 3)
    ]
    kind = "page_id bigint, points array<struct<pos:int,name:string,lat:string,lon:string>>, known array<struct<pos:int,name:string>>"
    matched = directory.match_array(F.col("points"), F.col("known"))
    got = spark.createDataFrame(rows, kind).select("page_id", F.inline(matched))
    found = {r.pos: (r.outcome, r.business_pos) for r in got.collect()}
    for page, pos, point in points:
        low = point.lower()
        mine = [(p, n) for pg, p, n in sorted(known) if pg == page]
        same = [p for p, n in mine if low in n.lower() or n.lower() in low]
        extra = []
        for p, n in mine:
            base = n.replace("&", "").replace(",", "").replace("LLC", "").replace("Inc", "")
            if any(w in low for w in base.lower().split() if len(w) > 3):
                extra.append(p)
        want = ("existing", min(same)) if same else ("extra", min(extra)) if extra else ("new", None)
        assert found[pos] == want, (page, point)


def test_service_rules(spark):
    label = lambda rules, text, default=False: spark.range(1).select(directory.service_labels(rules, F.lit(text), default).alias("x")).first().x
    assert label("name", "Dock Lift Trailer Marine Auto") == ["docks & lifts", "trailers", "marine", "auto"]
    assert label("name", "plain") == []
    assert label("map", "docks lifts transport trailer", True) == ["docks", "lifts", "trailers"]
    assert label("map", "plain", True) == ["docks & lifts"]
    assert label("cell", "trailer lift") == ["lifts"]


def test_route_choice_is_per_page(pages):
    df = pages(
        'map_markers="1 | 2 | Shop"' + _sections("Acme"),
        "<p>ACME MARINE</p><p>218-555-0123</p>" + _sections("Acme"),
        "[vc_row]" + _sections("Acme", "218-555-0123"),
        "nothing",
    )
    chosen = directory.page_businesses(df)
    assert rows(chosen, "page_id", "route", "name") == [(1, 1, "Shop"), (2, 2, "ACME MARINE"), (3, 4, "Acme")]


@pytest.mark.parametrize("searched", [20_000_000, -1])
def test_sections_at_names_equal_brute_force(spark, monkeypatch, searched):
    """Name by name, and through the index; names that repeat, overlap, hold one another or are not there."""
    monkeypatch.setattr(directory, "SEARCHED", searched)
    monkeypatch.setattr(directory, "UNIT", 16)
    rng = random.Random(4)
    word = lambda: rng.choice(["acme", "Dock", "ac", "a", "É co", "7", "of the long lake & river bay"])
    cases = []
    for i in range(60):
        text = "".join(rng.choice([word() + " ", word(), "\n", "\n 5 "]) for _ in range(rng.randint(0, 40)))
        cases.append((i, [f"{word()} {word()}".strip() if rng.random() < 0.5 else word() for _ in range(rng.randint(1, 6))], text))
    df = spark.createDataFrame(cases, "page_id bigint, names array<string>, text string")
    markers = F.transform("names", lambda n: F.struct(n.alias("name")))
    marked = directory._marked(F.col("text"))
    found = df.select("page_id", directory._sections_at(markers, marked, F.lower(marked)).alias("s"))
    got = {r.page_id: r.s for r in found.collect()}
    for i, names, text in cases:
        want = []
        for name in names:
            at = text.lower().find(name.lower())
            match = re.match(r"(?s).+?(?=\n\s*[A-Za-z][^\n]*\n|\Z)", text[at:]) if at >= 0 else None
            want.append(match and match.group(0))
        assert got[i] == want, (names, text)


def _sections_of(n: int) -> str:
    bodies = lambda i: (f"Shop {i}", f"{i} Oak Street", "218-555-0123", "Website", f'<a href="https://s{i}.test">x</a>')
    return "".join(_sections(*bodies(i)) for i in range(n // 5))


def test_large_pages_stay_fast(pages):
    """6,000 sections, 1,200 points against 1,200 names, 6,000 markers on one page."""
    points = _sections("<br />".join(f"1 | 2 | {'Shop' if i % 3 else 'Zed'} {i}" for i in range(1_200)))
    start = time.monotonic()
    assert directory.section_businesses(pages(_sections_of(6_000))).count() == 1_200
    assert directory.shortcode_businesses(pages(_sections_of(6_000) + points)).count() == 1_200 + 1
    markers = "\n".join(f"45.1 | -94.2 | Shop number {i} of town" for i in range(6_000))
    body = "".join(f"<p>Shop number {i} of town</p>\n 218-555-{i:04} \n{i} Oak St, Elk, MN 56000\n" for i in range(6_000))
    got = directory.business_details(pages(f'[nectar_gmap map_markers="{markers}"]{body}'))
    assert got.where(F.col("phone") == F.concat(F.lit("218-555-"), F.lpad("pos", 4, "0"))).count() == 6_000
    assert time.monotonic() - start < 60
