from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pageloom.operators import texts as text_jobs
from pageloom.plans import page_extract
from pageloom.sources import landed, sinks
from pageloom.streaming import ingest


def _item(number: int, slug: str = "", title: str = "T", body: str = "<p>b</p>", **more) -> dict:
    return {"id": number, "slug": slug, "title": {"rendered": title}, "content": {"rendered": body}, "link": f"https://a.test/{slug}", **more}


@pytest.fixture
def landing(tmp_path):
    """Landed item files of one site, one array per file."""

    def write(rest_base: str, *items: dict, part: int = 0) -> str:
        folder = tmp_path / "landing" / "site=a.test" / f"rest_base={rest_base}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{part}.json").write_text(json.dumps(list(items)))
        return str(tmp_path / "landing")

    return write


def test_items_and_manifest(spark, landing):
    landing("posts", _item(3, "p"))
    path = landing("pages", _item(1, "home", " A \n title "), _item(2, "", "", "  "), {"id": 4, "title": {"rendered": "only"}})
    items = landed.items(spark, path)
    assert rows(items, "site", "rest_base", "id") == [
        ("a.test", "pages", 1), ("a.test", "pages", 2), ("a.test", "pages", 4), ("a.test", "posts", 3),
    ]
    manifest = sinks.item_manifest(items.where("rest_base = 'pages'"), "dump/")
    assert rows(manifest, "id", "slug", "title", "raw_file") == [
        (1, "home", "A title", "dump/a.test/raw_pages/pages-home.txt"),
        (4, "4", "only", "dump/a.test/raw_pages/pages-4.txt"),
    ]


def test_pages_alone_are_read_for_a_type_filter(spark, landing):
    landing("posts", _item(3, "p"))
    path = landing("pages", _item(1, "home"))
    plan = landed.items(spark, path).where("rest_base = 'pages'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rest_base" in plan


def test_content_types(spark):
    types = json.dumps(
        {
            "page": {"rest_base": "sheets"}, "a": {"rest_base": "kits"}, "b": {"rest_base": "blocks"}, "c": {"rest_base": "hid", "viewable": False},
            "d": {"rest_base": "x/(?P<id>1)"}, "e": {"viewable": True}, "f": {"rest_base": "a+b"}, "g": {"rest_base": "pages"},
        }
    )
    df = spark.createDataFrame([("s", types)], "site string, types_json string")
    names = lambda **how: [r[1] for r in rows(landed.content_types(df, **how))]
    assert names() == ["pages", "posts"]
    assert names(include_all=True) == ["kits", "pages", "posts"]
    assert names(include_all=True, authenticated=True) == ["blocks", "kits", "pages", "posts"]


def test_only_chosen_types_are_kept(spark, landing):
    landing("hidden", _item(9, "x"))
    path = landing("pages", _item(1, "home"))
    types = spark.createDataFrame([("a.test", "pages")], "site string, rest_base string")
    assert rows(landed.of_types(landed.items(spark, path), types), "id") == [(1,)]


def test_page_lookup(spark):
    items = spark.createDataFrame(
        [("a.test", "posts", 1, "about", 0), ("a.test", "pages", 2, "about", 1), ("a.test", "pages", 3, "about", 2), ("a.test", "posts", 4, "news", 3), ("a.test", "other", 5, "home", 4)],
        "site string, rest_base string, id bigint, slug string, pos int",
    )
    wanted = spark.createDataFrame([("https://a.test/x/about/?q",), ("https://a.test/news",), ("https://a.test/",)], "url string")
    found = landed.find_pages(wanted, items)
    assert rows(found, "slug", "id") == [("about", 2), ("home", None), ("news", 4)]


def test_text_corpus_prefers_pretty_pages(spark, tmp_path):
    for site, folder, name, text in (
        ("s", "pretty_pages", "pages-home.txt", "a\nb"), ("s", "raw_pages", "pages-home.txt", "raw"), ("s", "pretty_pages", "plain.txt", "p"),
        ("t", "raw_pages", "posts-x-y.txt", "r"), ("t", "markdown_pages", "posts-x.md", "m"),
    ):
        where = tmp_path / site / folder
        where.mkdir(parents=True, exist_ok=True)
        (where / name).write_text(text)
    df = landed.text_corpus(spark, str(tmp_path))
    assert rows(df, "site", "category", "text") == [("s", "pages", "a\nb"), ("s", "unknown", "p"), ("t", "posts", "r")]


def test_index_join_skips_entries_without_file(spark, tmp_path):
    index = {
        "site": "https://a.test", "generated_at": 5,
        "items": [{"type": "pages", "id": 1, "raw_file": "out/s/raw_pages/pages-a.txt"}, {"type": "pages", "id": 2, "raw_file": "out/s/raw_pages/gone.txt"}, {"type": "posts", "id": 3, "raw_file": "x"}],
        "media": [{"id": 7, "file": "f"}],
    }
    (tmp_path / "index.json").write_text(json.dumps(index))
    raw = tmp_path / "out" / "s" / "raw_pages"
    raw.mkdir(parents=True)
    (raw / "pages-a.txt").write_text("text a")
    loaded = landed.index(spark, str(tmp_path / "index.json"))
    entries = landed.index_items(loaded, "pages")
    texts = landed.raw_files(spark, str(raw))
    assert rows(landed.with_texts(entries, texts, str(tmp_path)), "id", "text") == [(1, "text a")]
    assert rows(landed.index_media(loaded), "id", "file") == [(7, "f")]


def _media(spark, *entries):
    df = spark.createDataFrame([("s", pos, number, url) for pos, (number, url) in enumerate(entries)], "site string, pos int, id bigint, source_url string")
    return df.withColumns({c: F.lit(None).cast("string") for c in ("post", "alt_text", "title")})


def test_media_names(spark):
    df = _media(spark, (1, "http://c.test/x/a.png"), (2, "http://c.test/y/a.png?q"), (3, None), (4, "http://c.test/"), (5, "http://c.test/noext"), (6, "http://c.test/noext"))
    assert rows(sinks.media_manifest(df), "pos", "file") == [
        (0, "s/images/a.png"), (1, "s/images/a-2.png"), (3, "s/images/4.bin"), (4, "s/images/noext"), (5, "s/images/noext-6"),
    ]


def test_a_made_up_media_name_is_taken(spark):
    df = _media(spark, (1, "http://c.test/a.png"), (2, "http://c.test/a.png"), (3, "http://c.test/a-2.png"))
    assert rows(sinks.media_manifest(df), "pos", "file") == [(0, "s/images/a.png"), (1, "s/images/a-2.png"), (2, "s/images/a-2-3.png")]


def test_stored_rows_are_skipped(spark):
    new = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(landed.not_stored(new, new.where("id = 1"), ["id"])) == [(2,)]


def test_csv_round_trip_keeps_breaks_and_quotes(spark, pages, tmp_path):
    html = '<title>A "q"</title><p>12 Oak Rd, Elk,\nMN 56000 and 218-555-0123</p><h1>Hi</h1>'
    tables = page_extract.page_extract(pages(html))
    sinks.write_csv(tables["page_summary"], str(tmp_path / "summary"))
    back = spark.read.csv(str(tmp_path / "summary"), header=True, multiLine=True, escape='"')
    row = back.first()
    assert len(back.columns) == 34
    assert (row.meta_title, row.heading_count, row.phone_numbers) == ('A "q"', "1", "218-555-0123")
    assert "12 Oak Rd, Elk,\nMN 56000" in row.addresses
    sinks.write_details({"headings": tables["headings"].drop("page_id", "site", "pos")}, str(tmp_path / "details"))
    assert rows(spark.read.csv(str(tmp_path / "details" / "headings"), header=True)) == [("H1", "Hi")]


def test_summary_counts_businesses(pages):
    df = pages("<p>ACME MARINE</p><p>218-555-0123</p>", "plain")
    summary = page_extract.page_extract(df)["page_summary"]
    assert rows(summary, "page_id", "business_listings") == [(1, 1), (2, 0)]


def test_every_extract_table_runs(pages):
    html = '<h1>a</h1><a href="/b">c</a><img src="/i.png"><form></form><script type="application/ld+json">{"a":1}</script>218-555-0123 facebook'
    for name, table in page_extract.page_extract(pages(html)).items():
        assert table.count() >= (0 if name == "business_data" else 1), name


def spark_columns(path):
    import pyarrow.dataset as ds

    return ds.dataset(str(path)).schema.names


def test_stored_extract_equals_the_direct_one(pages, tmp_path):
    html = '<title>t</title><h1>a</h1><a href="/b">c</a><img src="/i.png" alt="x"><form><input name="q"></form><script type="application/ld+json">{"a":1}</script>x@y.test'
    df = pages(html, "plain")
    direct = page_extract.page_extract(df)
    stored = page_extract.page_extract(df, store=str(tmp_path / "store"))
    assert "html" not in spark_columns(tmp_path / "store" / "pages")
    for name, table in direct.items():
        other = stored[name]
        if name == "page_summary":
            table, other = table.drop("extracted_at"), other.drop("extracted_at")
        if name == "schema_markup":
            table, other = (t.withColumn("markup", F.to_json("markup")) for t in (table, other))
        assert rows(table) == rows(other.select(table.columns)), name


def test_business_csv_joins_lists(spark):
    df = spark.range(1).select(
        F.lit("Acme").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("address", "address_url", "phone", "website_url")],
        F.array(F.lit("docks"), F.lit("lifts")).alias("services"),
        F.array(F.struct(F.lit("North").alias("name"), F.lit(1.5).alias("lat"), F.lit(-2.0).alias("lon"))).alias("extra_locations"),
        F.lit("sections").alias("source"),
    )
    assert rows(sinks.business_csv(df)) == [("Acme", "", "", "", "", "docks & lifts", "North (1.5, -2.0)", "sections")]


def test_json_and_text_tables(spark, landing, tmp_path):
    items = landed.items(spark, landing("pages", _item(1, "home")))
    clean = text_jobs.items_clean(items).withColumnRenamed("id", "page_id")
    sinks.write_page_text(text_jobs.page_text(clean.select("page_id", "site", "rest_base", "title", "url", "html")), str(tmp_path / "text"))
    assert rows(spark.read.parquet(str(tmp_path / "text")), "site", "rest_base", "raw_text") == [("a.test", "pages", "T\n\nb")]
    manifest, media = sinks.site_index(sinks.item_manifest(items), _media(spark))
    sinks.write_json(manifest, str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "index")).first().generated_at > 0
    assert media.count() == 0


def test_incremental_ingest(spark, landing, tmp_path):
    stamp, old, new = "2024-01-01T00:00:00", "2018-01-01T00:00:00", "2024-03-01T00:00:00"
    path = landing("pages", _item(1, "home", modified=stamp), _item(1, "home", modified=stamp))
    out = str(tmp_path / "out")

    def run(state):
        files = ingest.landed_files(spark, path)
        ingest.ingest(files, out, str(tmp_path / state)).awaitTermination(120)
        return rows(ingest.stored(spark, out, "items"), "page_id", "modified")

    run("state")
    # An item changed years ago lands after newer ones; a repeat lands, too.
    landing("pages", _item(1, "home", modified=stamp), _item(2, "old", modified=old), _item(3, "none"), part=1)
    assert [i for i, _ in run("state")] == [1, 2, 3]
    # A new version is stored beside the old one, and a broken file is kept aside.
    landing("pages", _item(1, "home", modified=new), _item(3, "none"), part=2)
    (tmp_path / "landing/site=a.test/rest_base=pages/3.json").write_text('[{"id": 9, "slug": "cut')
    assert [i for i, _ in run("state")] == [1, 1, 2, 3]
    # A lost stream checkpoint starts over: nothing is lost, nothing comes twice.
    before = rows(ingest.stored(spark, out, "items"), "page_id", "modified")
    assert run("other state") == before
    assert rows(ingest.stored(spark, out, "page_audit"), "page_id") == [(1,), (1,), (2,), (3,)]
    assert ingest.stored(spark, out, "page_text").count() == 4
    assert rows(ingest.stored(spark, out, "rejected").select("text").distinct(), "text") == [('[{"id": 9, "slug": "cut',)]


def test_undated_items_are_told_by_what_they_hold(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    path = landing("pages", _item(1, "home", "first"), _item(1, "home", "first"))

    def run():
        ingest.ingest(ingest.landed_files(spark, path), out, str(tmp_path / "state")).awaitTermination(120)
        return rows(ingest.stored(spark, out, "items"), "page_id", "title", "modified")

    assert run() == [(1, "first", None)]
    landing("pages", _item(1, "home", "second"), _item(1, "home", "first"), part=1)
    assert run() == [(1, "first", None), (1, "second", None)]


def test_unreadable_records_are_kept_aside(spark, landing, tmp_path):
    path = landing("pages", _item(1, "home"), {"slug": "no id"}, 7)
    (tmp_path / "landing/site=a.test/rest_base=pages/bad.json").write_text('[{"id": 2}, {"id"')
    files = landed.item_files(spark, path)
    assert rows(landed.items(spark, path), "id") == [(1,)]
    found = [(r.place, r.text[:8], r.rest_base) for r in landed.rejected(files).orderBy(F.col("place").asc_nulls_first()).collect()]
    assert found == [(None, '[{"id": ', "pages"), (1, '{"slug":', "pages"), (2, "7", "pages")]


def test_every_record_is_read_or_kept_aside(spark, landing):
    path = landing("pages", {"id": 1}, {"id": "12"}, {"id": 1.5}, {"id": None}, {"id": 2, "author": "x"}, [3], "4")
    read = landed.items(spark, path).select(F.col("pos.place").alias("place"))
    aside = landed.rejected(landed.item_files(spark, path)).select("place")
    assert rows(read.unionByName(aside), "place") == [(i,) for i in range(7)]
    assert (1,) in rows(aside, "place")


def test_landed_media_make_a_manifest(spark, tmp_path):
    folder = tmp_path / "media" / "site=a.test"
    folder.mkdir(parents=True)
    entries = [{"id": i, "source_url": "http://c.test/a.png", "post": 1, "alt_text": "x", "title": {"rendered": "T"}} for i in (5, 4)]
    (folder / "0.json").write_text(json.dumps(entries))
    manifest = sinks.media_manifest(landed.media(spark, str(tmp_path / "media")))
    assert rows(manifest, "id", "file", "title") == [(4, "a.test/images/a-4.png", "T"), (5, "a.test/images/a.png", "T")]


def test_landed_items_answer_lookups(spark, landing):
    landing("posts", _item(3, "home"))
    path = landing("pages", _item(2, "home"), _item(1, "home"))
    wanted = spark.createDataFrame([("https://a.test/home/",), ("https://a.test/gone",)], "url string")
    assert rows(landed.find_pages(wanted, landed.items(spark, path)), "url", "id") == [
        ("https://a.test/gone", None), ("https://a.test/home/", 2),
    ]


def test_texts_are_found_by_whole_paths(spark):
    entries = spark.createDataFrame([("s/raw_pages/a.txt",), ("/r3/s/raw_pages/a.txt",)], "raw_file string")
    texts = spark.createDataFrame([(f"file:///r{i}/s/raw_pages/a.txt", str(i)) for i in (1, 2, 3)], "path string, text string")
    assert rows(landed.with_texts(entries, texts, "/r1"), "raw_file", "text") == [
        ("/r3/s/raw_pages/a.txt", "3"), ("s/raw_pages/a.txt", "1"),
    ]
