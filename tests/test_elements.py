from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from pageloom.operators import elements


def test_headings(pages):
    df = pages("<h2>b &amp; <i>c</i></h2><H1 id=x> a </H1><h3></h3>", "none", None)
    assert rows(elements.headings(df), "page_id", "pos", "level", "text", "length", "word_count", "is_empty") == [
        (1, 0, 1, "a", 1, 1, False),
        (1, 1, 2, "b & c", 5, 3, False),
        (1, 2, 3, "", 0, 0, True),
    ]
    assert rows(elements.filled_headings(df), "level", "text") == [("H1", "a"), ("H2", "b &amp; c")]


def test_heading_hierarchy(pages):
    h = lambda *levels: "".join(f"<h{n}>x</h{n}>" for n in levels)
    df = elements.heading_structure(pages(h(1, 2, 3), h(1, 3), h(1, 1), h(2), h()))
    assert rows(df, "page_id", "has_proper_hierarchy") == [(1, True), (2, False), (3, False), (4, False), (5, False)]


def test_links_by_look_and_by_scope(pages):
    df = pages(
        '<a name=t></a><a href="/a">A</a><a href="tel:1">B</a><a href=\'https://x.test/\'>C</a>'
        '<a href="https://a.test/z">D</a><a href="http://x.test/?u=a.test"> </a><abbr href="/n">n</abbr>'
    )
    assert rows(elements.links(df), "pos", "url", "link_type", "scope") == [
        (0, "/a", "internal", "internal"),
        (1, "tel:1", "internal", "internal"),
        (2, "https://x.test/", "external", "external"),
        (3, "https://a.test/z", "external", "internal"),
        (4, "http://x.test/?u=a.test", "external", "internal"),
    ]
    assert elements.listed_links(df).count() == 4
    assert rows(elements.external_links(df), "domain") == [("x.test",)]


def test_links_of_a_page_without_url_have_no_scope(pages):
    df = elements.links(pages('<a href="/a">A</a>', url=""))
    assert rows(df, "scope") == [(None,)]


def test_images_and_media(pages):
    df = pages(
        '<img src="a" alt=""><img src="/b"><img alt="x">'
        '<iframe src="https://player.vimeo.com/1"></iframe><iframe src="/maps"></iframe><audio src="//c.test/s.mp3">'
    )
    assert rows(elements.images(df), "pos", "has_alt", "alt_length") == [(0, True, 0), (1, False, 0), (2, True, 1)]
    assert rows(elements.media(df), "kind", "src") == [
        ("audio", "https://c.test/s.mp3"),
        ("image", "a"),
        ("image", "https://a.test/b"),
        ("video", "https://player.vimeo.com/1"),
    ]
    assert elements.first_images(df, 2).count() == 2


def test_forms_and_fields(pages):
    df = pages('<form action="/s" METHOD="post"><input type="email" name="m"><select name=\'s\'></select><input type="submit"></form><form></form>')
    assert rows(elements.forms(df), "form_no", "action", "method") == [(0, "/s", "POST"), (1, "", "GET")]
    assert rows(elements.form_fields(df), "pos", "name", "type") == [(0, "m", "email"), (1, "s", "text")]


def test_seo_tags_in_any_attribute_order_and_quote(pages):
    df = pages("""<title> T </title><meta content="it's > all" name="Description"><meta property='og:title' content='O "q"'>
        <link href="/c" rel="canonical"><meta name="robots" content="a"><meta name="robots" content="b">""")
    row = elements.seo_tags(df).first()
    assert (row.meta_title, row.meta_description, row.og_title) == ("T", "it's > all", 'O "q"')
    assert (row.canonical_url, row.robots, row.meta_keywords) == ("/c", "a", "")


def test_seo_tags_prefer_plugin_heads(pages):
    df = pages("<title>page</title>", "<title>page</title>").withColumn(
        "yoast_head", F.when(F.col("page_id") == 1, "<title>plugin</title>").otherwise("")
    )
    assert rows(elements.seo_tags(df), "page_id", "meta_title") == [(1, "plugin"), (2, "page")]


def test_structured_data_drops_broken_json(pages):
    ld = '<script type="application/ld+json">{}</script>'
    df = pages(ld.format(' {"a": {"b": 2}} ') + ld.format("{broken"))
    found = elements.schema_markup(df).select("pos", F.try_variant_get("markup", "$.a.b", "int").alias("b"))
    assert rows(found) == [(0, 2)]


def test_titles_and_descriptions(pages):
    df = pages("<title>A &amp; the dock builders of Elk River</title>", "<b>")
    assert rows(elements.page_titles(df), "length", "word_count", "has_brand", "optimal_length") == [
        (0, 0, False, False),
        (34, 8, True, True),
    ]
    text = "d" * 130
    described = elements.meta_descriptions(pages(f'<meta name="description" content="{text}">')).first()
    assert (described.length, described.optimal_length) == (130, True)


def test_page_contacts(texts):
    df = texts("Call (218) 555-0123 or 218.555.0123, id 8433770898 at a.b@c.test, a.b@c.test. Twitter: 12 Oak Rd, Elk, MN 56000-1234")
    found = elements.page_contacts(df)
    phones = found.where("kind = 'phone'")
    assert rows(phones, "pattern_no", "value") == [
        (1, "218.555.0123"),
        (1, "8433770898"),
        (2, "(218) 555-0123"),
    ]
    assert rows(phones.select("normalized").distinct()) == [("2185550123",), ("8433770898",)]
    assert rows(found.where("kind = 'email'"), "value") == [("a.b@c.test",)]
    assert rows(found.where("kind = 'social'"), "value") == [("twitter",)]
    assert rows(found.where("kind = 'address'"), "pattern_no", "value") == [
        (1, "12 Oak Rd, Elk, MN 56000-1234"),
        (2, "Elk, MN 56000-1234"),
    ]


def test_city_may_cross_lines_unless_told_otherwise(texts):
    df = texts("go to\nPort Wing, WI 54865")
    broad = elements.page_contacts(df).where("kind = 'address'")
    assert rows(broad, "value") == [("Port Wing, WI 54865",)]
    df = texts("Red Barn\nPort Wing, WI 54865")
    assert rows(elements.page_contacts(df).where("kind = 'address'"), "value") == [("Red Barn\nPort Wing, WI 54865",)]
    narrow = elements.page_contacts(df, same_line=True).where("kind = 'address'")
    assert rows(narrow, "value") == [("Port Wing, WI 54865",)]


def test_corpus_contacts_are_distinct(texts):
    df = texts("218-555-0123 218-555-0123 x@y.test http://a.test/b, http://a.test/b,")
    assert rows(elements.corpus_contacts(df), "kind", "value") == [
        ("email", "x@y.test"),
        ("phone", "218-555-0123"),
        ("url", "http://a.test/b,"),
    ]


def test_emails_with_adjoining_matches(texts):
    import re

    from pageloom.functions import fixed

    samples = ["a@b.com_c@d.org", "a@b.com1x@y.org", "x" * 50 + "@", "..@a.bc", "a@b@c.de", "%a@b.c.d.ef-g@h.ij"]
    df = elements.corpus_contacts(texts(*samples)).where("kind = 'email'").groupBy("page_id").agg(F.sort_array(F.collect_list("value")).alias("v"))
    got = {r.page_id: r.v for r in df.collect()}
    for i, s in enumerate(samples, 1):
        assert got.get(i, []) == sorted(set(re.findall(fixed.EMAIL, s))), s


def test_corpus_addresses(texts):
    df = elements.corpus_addresses(texts("in Elk River, MN 56000 and Ely,WI 54865-1111"))
    assert rows(df, "pos", "city", "state", "zip_code") == [(0, "Elk River", "MN", "56000"), (1, "Ely", "WI", "54865-1111")]
