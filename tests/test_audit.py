from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from pageloom.operators import audit, rollups
from pageloom.plans import site_reports

WORDS = "The cat sat on the big red mat in the sun. " * 35
FULL = (
    "<title>Three good words for a page title here</title>"
    f'<meta name="description" content="{"d" * 130}">'
    '<h1>a</h1><h2>b</h2><img src="a" alt="b">'
    '<a href="/1">x</a><a href="/2">x</a><a href="/3">x</a><a href="https://b.test">y</a>'
    f"<p>{WORDS}</p>"
)


def test_full_marks_and_none(pages):
    df = audit.page_audit(pages(FULL, "", None))
    got = {r.page_id: r for r in df.collect()}
    assert got[1].seo_score == 100 and got[1].issues == []
    assert got[2].seo_score == 0
    assert [i.code for i in got[2].issues] == [
        "title_missing", "description_missing", "h1_missing", "hierarchy_poor", "content_short", "hard_to_read",
    ]


def test_score_is_the_sum_of_its_parts(pages):
    df = audit.page_audit(pages(FULL, FULL.replace("<h1>a</h1>", ""), "<title>x</title>", "<img src=a><img src=b alt=''>"))
    total = sum((F.col(name) for name in audit.POINTS), F.lit(0))
    assert df.where((total != F.col("seo_score")) | ~F.col("seo_score").between(0, 100)).count() == 0


def test_image_points_truncate(pages):
    img = lambda n, alt: "<img src='a' alt='b'>" * alt + "<img src='a'>" * (n - alt)
    df = audit.page_audit(pages(img(3, 2), img(3, 3), img(0, 0)))
    assert rows(df, "page_id", "image_points", "images_without_alt") == [(1, 6, 1), (2, 10, 0), (3, 0, 0)]


def test_messages_carry_their_figures(pages):
    row = audit.readable_audit(audit.page_audit(pages("<title>Hello</title><h1>a</h1><h1>b</h1><p>" + "w " * 200 + "</p>"))).first()
    assert "Title length is 5 characters (optimal: 30-60)" in row.issues
    assert "Multiple H1 tags found (2)" in row.issues
    assert "Consider adding more content (current: 200 words)" in row.recommendations


def test_visible_text_joins_neighbours_and_counts_scripts(pages):
    row = audit.page_facts(pages("<p>one</p><p>two</p><script>three four</script>")).first()
    assert row.word_count == 2


def test_unreadable_page(pages):
    row = audit.page_facts(pages("<b></b>")).first()
    assert (row.flesch_score, row.grade_level, row.avg_sentence_length) == (0.0, "Unknown", None)


def _three_sites(spark):
    return spark.createDataFrame(
        [(1, "http://a.test/1", FULL), (2, "http://a.test/2", ""), (3, "http://b.test/1", "")], "page_id bigint, url string, html string"
    )


def test_site_rollups(spark):
    df = audit.page_audit(_three_sites(spark))
    assert rows(audit.site_scores(df)) == [("a.test", 2, 50.0), ("b.test", 1, 0.0)]
    assert rows(audit.score_bands(df)) == [("a.test", "excellent", 1), ("a.test", "poor", 1), ("b.test", "poor", 1)]
    assert ("b.test", "h1_missing", 1) in rows(audit.note_counts(df, "issues"))
    assert rows(audit.first_pages(df, 1), "site", "page_id") == [("a.test", 1), ("b.test", 3)]
    top = audit.top_notes(df, "issues", 2)
    assert rows(top.where("site = 'b.test'"), "rank", "code") == [(1, "content_short"), (2, "description_missing")]


def test_one_pass_report_equals_its_parts(spark):
    pages = _three_sites(spark)
    df = audit.page_audit(pages)
    report = site_reports.site_issue_report(pages, 3)
    assert rows(report.select("site", "total_pages", "avg_seo_score").distinct()) == rows(audit.site_scores(df))
    expected = audit.top_notes(df, "issues", 3).select("site", "rank", "code", "pages")
    assert rows(report.select("site", "issue_rank", "issue", "issue_pages").where("issue is not null")) == rows(expected)


def test_a_site_without_issues_stays_in_the_report(spark):
    df = spark.createDataFrame([(1, "http://a.test/1", FULL)], "page_id bigint, url string, html string")
    assert rows(site_reports.site_issue_report(df)) == [("a.test", 1, 100.0, None, None, None)]


def test_bands(pages):
    row = audit.page_bands(audit.page_audit(pages(FULL))).first()
    assert (row.score_band, row.title_band, row.word_band, row.h1_band) == ("excellent", "good", "good", "good")


def _corpus(spark, *rows_):
    return spark.createDataFrame(rows_, "site string, category string, text string")


def test_empty_texts_count_as_files_only(spark):
    ten = "one two three four five six seven eight nine ten."
    df = rollups.site_content(_corpus(spark, ("s", "pages", ""), ("s", "pages", ten), ("s", "x", None)))
    row = df.first()
    assert (row.total_files, row.page_files, row.total_words, row.total_characters) == (3, 2, 10, len(ten))
    assert row.avg_readability == rollups.site_content(_corpus(spark, ("s", "pages", ten))).first().avg_readability


def test_site_contacts_are_distinct_over_texts(spark):
    df = _corpus(spark, ("s", "a", "218-555-0123 x@y.test"), ("s", "a", "218-555-0123 http://z.test"), ("t", "a", "218-555-0123"))
    assert rows(rollups.site_contacts(df)) == [
        ("s", "email", "x@y.test"), ("s", "phone", "218-555-0123"), ("s", "url", "http://z.test"), ("t", "phone", "218-555-0123"),
    ]
    assert rows(rollups.site_content(df), "site", "phone_count", "email_count", "url_count") == [("s", 1, 1, 1), ("t", 1, 0, 0)]


def test_insight_thresholds(spark):
    schema = "site string, total_words bigint, avg_readability double, phone_count bigint, email_count bigint, url_count bigint, page_files bigint"
    df = spark.createDataFrame(
        [("a", 5000, 80.0, 5, 3, 20, 10), ("b", 5001, 79.9, 6, 4, 21, 11), ("c", 10001, 59.0, 0, 0, 0, 0), ("d", 0, None, 0, 0, 0, 0)], schema
    )
    got = {}
    for r in rollups.site_insights(df).collect():
        got.setdefault(r.site, set()).add(r.code)
    assert got == {
        "a": {"compact_content", "very_readable"},
        "b": {"medium_content", "fairly_readable", "many_phones", "many_emails", "many_urls", "many_pages"},
        "c": {"large_content", "complex"},
    }
    assert "📚 Large content site with 10,001 total words" in [r.message for r in rollups.site_insights(df).collect()]


def test_combined_keeps_sites_of_either_side(spark):
    content = spark.createDataFrame([("a", 7, 2, 1)], "site string, total_words bigint, total_files bigint, phone_count bigint")
    scores = spark.createDataFrame([("b", 3, 40.0)], "site string, total_pages bigint, avg_seo_score double")
    assert rows(rollups.combined(content, scores)) == [("a", 7, 0.0, 2, 1, 0), ("b", 0, 40.0, 0, 0, 3)]


def test_report_tables_are_lazy_and_complete(spark):
    tables = site_reports.site_audit(_three_sites(spark)) | site_reports.site_content_report(_corpus(spark, ("s", "pages", "a b.")))
    assert {"pages", "scores", "top_issues", "first_pages", "summary", "contacts", "insights"} <= set(tables)
    assert tables["categories"].count() == 1
