"""What the optimizer makes of the jobs: shuffles, repeated work, pruning."""

from __future__ import annotations

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pageloom.functions import text as X
from pageloom.functions.rows import exploded
from pageloom.operators import audit, directory, elements, rollups, terms, texts
from pageloom.plans import page_extract, samples, site_reports


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame(
        [(1, "http://a.test/1", "<title>a</title><h1>b</h1> x", "unused"), (2, "http://b.test/2", "", "unused")],
        "page_id bigint, url string, html string, extra string",
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_figures_of_a_page_do_not_shuffle(stored):
    text = stored.select("page_id", X.visible_text(F.col("html")).alias("text"))
    for job in (
        audit.page_audit(stored),
        page_extract.page_summary(stored),
        elements.links(stored),
        elements.seo_tags(stored),
        texts.page_text(stored.drop("extra")),
        texts.text_stats(text),
        terms.keyword_density(text),
        directory.line_businesses(text),
    ):
        assert "Exchange" not in plan(job)


def test_only_needed_columns_are_read(stored):
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan(audit.page_audit(stored))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(stored.select("page_id", X.site_key(F.col("url"))))


def test_arrays_are_not_computed_in_a_filter_below(stored):
    page_audit = audit.page_audit(stored)
    for job in (
        audit.note_counts(page_audit, "issues"),
        site_reports.site_issue_report(stored),
        elements.form_fields(stored),
        elements.headings(stored),
        texts.text_stats(stored.select("page_id", X.visible_text(F.col("html")).alias("text"))),
    ):
        filters = [line for line in plan(job).splitlines() if re.match(r"[\s:+|-]*Filter ", line)]
        assert not [line for line in filters if "regexp" in line or "size(" in line]


def test_site_reports_read_their_input_once(stored):
    assert plan(site_reports.site_issue_report(stored)).count("FileScan") == 1
    assert plan(site_reports.page_overview(stored)).count("FileScan") == 1
    corpus = stored.select(X.site_key(F.col("url")).alias("site"), F.lit("pages").alias("category"), F.col("html").alias("text"))
    assert plan(rollups.site_content(corpus)).count("FileScan") == 1


def test_overview_of_pages_equals_the_two_sided_one(pages):
    df = pages("<title>One</title><p>call 218-555-0123, 218-555-0123 or 218-555-0199</p>", "<p>218-555-0123</p>", "", None)
    df = df.union(pages("<h1>x</h1> a b c", url="https://b.test/y"))
    names = ["site", "total_words", "avg_seo_score", "total_files", "phone_count", "total_pages"]
    texts_of = site_reports.audited_texts(df)
    both = site_reports.site_overview(texts_of, df)
    assert rows(site_reports.page_overview(df), *names) == rows(both, *names)
    # A side may lack a site.
    left = site_reports.site_overview(texts_of.where("site = 'a.test'"), df.where("url like '%b.test%'"))
    assert [(r[0], r[3] > 0, r[5] > 0) for r in rows(left, *names)] == [("a.test", True, False), ("b.test", False, True)]


def test_first_of_group_jobs_limit_before_the_shuffle(stored):
    assert plan(audit.first_pages(audit.page_audit(stored))).count("WindowGroupLimit") == 2
    listed = stored.select("page_id", F.col("page_id").alias("pos"), F.lit(1).alias("priority"), F.col("html").alias("name"))
    assert plan(directory.dedupe_businesses(listed)).count("WindowGroupLimit") == 2


def test_directory_jobs_stay_in_the_row(stored):
    """One scan and no shuffle, from the HTML to the businesses of every route."""
    for job in (
        directory.section_businesses(stored),
        directory.match_points(stored),
        directory.shortcode_businesses(stored),
        directory.merged_businesses(stored.withColumnRenamed("html", "text")),
        directory.page_businesses(stored),
        directory.block_businesses(stored),
    ):
        text = plan(job)
        assert text.count("FileScan") == 1 and "Exchange" not in text and "Join" not in text


def test_exploded_drops_empty_and_null_arrays(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k int, v array<string>")
    assert rows(exploded(df, "v", "k")) == [(1, 0, "a"), (1, 1, "b")]


def test_building_a_plan_starts_no_job(spark, pages):
    df = pages("<div class='card'><p>A</p><p>B</p></div>", None)
    spark.sparkContext.setJobGroup("built", "plans only")
    directory.page_businesses(df).explain()
    directory.match_points(df).explain()
    page_extract.page_extract(df)
    started = spark.sparkContext.statusTracker().getJobIdsForGroup("built")
    spark.sparkContext.setJobGroup("", "")
    assert not started


def test_hostile_pages_stay_fast(spark):
    import time

    cases = ["<a href='/x'>t " * 10000, "<h2>t <p>t " * 10000, "<script>v " * 10000, " " * 200000, "<" * 100000, "7" * 100000]
    df = spark.createDataFrame([(i, "http://a.test/", c) for i, c in enumerate(cases)], "page_id bigint, url string, html string")
    start = time.monotonic()
    counts = rows(page_extract.page_metrics(df.repartition(len(cases))), "page_id", "heading_count", "link_count", "paragraph_count")
    assert counts == [(i, 0, 0, 0) for i in range(len(cases))]
    assert time.monotonic() - start < 60


def test_pages_made_from_one_row_group_are_read_by_all_cores(spark, tmp_path):
    made = spark.range(800).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(id % 9 AS INT) AS p_size")
    made.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for job in (elements.seo_tags, elements.headings, elements.filled_headings, audit.page_audit):
        made_from = job(samples.product_pages(spark, str(tmp_path)))
        per_task = made_from.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("page_id").alias("pages")).collect()
        assert sum(r.pages for r in per_task) == 800
        assert max(r.pages for r in per_task) <= 800 / spark.sparkContext.defaultParallelism
