"""Pages with known content, written from the star-schema tables.

A job that reads markup back must find the columns the markup was written from, which gives a check that
does not repeat the job's patterns. Every row makes a page of its own, or ten neighbouring keys share
one, so pages stay small and their number grows with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PER_PAGE = 10


def template(text: str) -> Column:
    """A string expression from text with {column} places."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows are dealt evenly to all cores.

    Its narrow rows compress well, so one row group, and thus one task, can hold millions of them, each a page to be
    searched. The narrow rows are dealt out, not the pages made from them.
    """
    return table(spark, sf_dir, name, *columns).repartition(2 * spark.sparkContext.defaultParallelism)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url", "html")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts(page_id, text)."""
    return table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "page_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a corpus: the source is the site, the language the category."""
    return table(spark, sf_dir, "documents", "source", "lang", "text").select(
        F.col("source").alias("site"), F.col("lang").alias("category"), "text"
    )


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per part with meta tags, headings of all levels, images, videos and audio."""
    part = spread(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    odd = F.col("p_size") % 2 == 1
    head = F.concat(
        template("<html><head><title> {p_name} &amp; {p_brand} of {p_type} </title>"),
        template("<meta content=\"{p_name}'s page > {p_brand}\" name=\"description\">"),
        template("<meta name='keywords' content='{p_type}, {p_brand}'/>"),
        template('<meta property="og:title" content="{p_name}"><meta property="og:description" content="">'),
        F.when(odd, template('<meta property="og:image" content="/img/{p_partkey}.png">')).otherwise(""),
        template('<link rel="stylesheet" href="/x.css"><link href="https://shop.example.com/p/{p_partkey}" rel="canonical">'),
        F.when(odd, F.lit("<META NAME='robots' CONTENT='noindex'>")).otherwise(""),
        F.lit('<meta name="twitter:card" content="summary"></head><body>'),
    )
    body = F.concat(
        template("<h1>{p_name}</h1><H2 class='b'> <i>{p_brand}</i> &amp; co</H2>"),
        F.when(odd, template("<h3>{p_type}</h3>")).otherwise(template("<h4>{p_type}</h4>")),
        template('<h5> </h5><p>Size {p_size}</p><pre>code</pre><IMG data-src="lazy" src="/img/{p_partkey}.png" alt="{p_name}" title="{p_brand}">'),
        F.when(odd, template("<img alt='' src='//cdn.example.com/{p_partkey}.jpg'>")).otherwise(
            template('<img src="https://cdn.example.com/{p_partkey}.gif">')
        ),
        template('<video controls src="/v/{p_partkey}.mp4"></video><iframe src="https://maps.example.com/{p_size}"></iframe>'),
        F.when(odd, template('<iframe width="1" src="https://www.youtube.com/embed/{p_partkey}"></iframe>')).otherwise(
            template('<embed src="//cdn.example.com/video-{p_partkey}.swf">')
        ),
        template('<audio src="/a/{p_partkey}.mp3"></audio></body></html>'),
    )
    return part.select(
        F.col("p_partkey").alias("page_id"),
        template("https://shop.example.com/p/{p_partkey}").alias("url"),
        F.concat(head, body).alias("html"),
    )


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per supplier with two forms."""
    supplier = spread(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    html = F.concat(
        template("<form action='/order/{s_suppkey}' method=\"post\"><input type='email' name='mail_{s_nationkey}'><input name=\"qty\">"),
        template('<textarea class="w" name="note_{s_suppkey}"></textarea><select name=\'nation_{s_nationkey}\'><option></select><input type="submit"></form>'),
        template('<form class="search"><input name="{s_name}" type="search"></form>'),
    )
    return supplier.select(
        F.col("s_suppkey").alias("page_id"), template("https://s{s_nationkey}.example.org/f/{s_suppkey}").alias("url"), html.alias("html")
    )


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer with links of every kind."""
    customer = spread(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    html = F.concat(
        template("<a name='top'></a><a href='/c/{c_custkey}'><b>{c_name}</b></a><a class=x href=\"https://n{c_nationkey}.example.com/home\"> Home &amp; more </a>"),
        template('<abbr href="/no">no</abbr><a href="tel:555{c_custkey}">call</a><a href="http://{c_mktsegment}.example.net/a?b=1">{c_mktsegment}</a>'),
        template('<a href="https://www.facebook.com/{c_custkey}"><img src="f.png"></a><a href="">empty</a>'),
    )
    return customer.select(
        F.col("c_custkey").alias("page_id"), template("https://n{c_nationkey}.example.com/c/{c_custkey}").alias("url"), html.alias("html")
    )


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per event with its properties as structured data, and a broken script beside them."""
    events = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    html = template(
        '<script>var a=1</script><script type="application/ld+json"> {props} </script>'
        "<SCRIPT id='b' type='application/ld+json'>[{event_type}</SCRIPT>"
    )
    return events.select(
        F.col("event_id").alias("page_id"), template("https://e.example.com/{event_id}").alias("url"), html.alias("html")
    )


def shortcode_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text per part wrapped in page-builder shortcodes."""
    part = spread(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    text = F.concat(
        template('[vc_row full="{p_size}"][vc_column_text]{p_name}[/vc_column_text][/vc_row]'),
        template('[vc_raw_html]JTND{p_partkey}[/vc_raw_html][divider line="x"][et_pb_section a="1"] {p_brand} [/et_pb_section]'),
        template('[H2] kept [gallery ids="{p_partkey}" size="big"][/gallery][nectar_btn url="u"][ultimate_spacer h="3"][Size {p_size}]'),
    )
    return part.select(F.col("p_partkey").alias("page_id"), text.alias("text"))


def phone_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory-like text per customer with phones in several spellings.

    phone holds the ten digits in the one shape all spellings become.
    """
    customer = spread(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    n = F.col("c_custkey")
    parted = customer.select(
        "*",
        (F.lit(200) + n % 700).alias("a"),
        (F.lit(201) + n % 797).alias("b"),
        F.lpad((n % 10000).cast("string"), 4, "0").alias("c"),
        F.lpad((n % 90000 + 10000).cast("string"), 5, "0").alias("z"),
    )
    text = F.concat(
        template("{c_name}\r\nCall ({a}) {b}-{c} now\n\n\n\nor 1-{a}-{b}.{c}"),
        template("\nElk River, MN {z} open Website | https://c{c_custkey}.example.com/x\nmail c{c_custkey}@example.com today"),
        template("\nmap 45.{c} | -94.{z} | {c_name} \nhttps://www.google.com/maps/place/{c_custkey} end  "),
    )
    return parted.select(
        F.col("c_custkey").alias("page_id"), "a", "b", "c", "z", "c_name", text.alias("text")
    )


def address_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text per supplier with a street address, a city-only address and social names."""
    supplier = spread(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    zipped = supplier.withColumn("z", F.lpad((F.col("s_suppkey") % 90000 + 10000).cast("string"), 5, "0"))
    text = template(
        "visit us: {s_suppkey}5 Oak Lane, Elk River, MN {z}-1234. find us on Facebook and YouTube.\n"
        "branch: Port Wing, WI {z}; mail s{s_suppkey}@example.org, s{s_suppkey}@example.org\n"
        "see https://s{s_nationkey}.example.org/{s_suppkey} or http://a.example.net"
    )
    return zipped.select(F.col("s_suppkey").alias("page_id"), text.alias("text"))


def _ten_to_a_page(rows: DataFrame, key: str, piece: Column, head: str, tail: str, base: str) -> DataFrame:
    """Pages of ten pieces each in key order."""
    keyed = rows.select(F.floor(F.col(key) / PER_PAGE).cast("bigint").alias("page_id"), F.struct(F.col(key), piece.alias("piece")).alias("p"))
    grouped = keyed.groupBy("page_id").agg(F.sort_array(F.collect_list("p"))["piece"].alias("pieces"))
    return grouped.select(
        "page_id",
        F.concat(F.lit(base), F.col("page_id")).alias("url"),
        F.concat(F.lit(head), F.array_join("pieces", ""), F.lit(tail)).alias("html"),
    )


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with an invented place: latitude, longitude, ZIP and phone from the key."""
    supplier = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    k = F.col("s_suppkey")
    return supplier.select(
        "*",
        F.lpad((k % 90000 + 10000).cast("string"), 5, "0").alias("z"),
        F.lpad((k % 10000).cast("string"), 4, "0").alias("c"),
        F.when(k % 4 == 0, "Dock and Lift").when(k % 4 == 1, "Marine").when(k % 4 == 2, "Trailer Auto").otherwise("Goods").alias("trade"),
        F.lpad((k % 1000).cast("string"), 3, "0").alias("d"),
    )


def marker_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map widgets of ten customers each, every fifth with a broken latitude, and texts at their names."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    rows = customer.select(
        "*",
        F.lpad((k % 10000).cast("string"), 4, "0").alias("c"),
        F.lpad((k % 90000 + 10000).cast("string"), 5, "0").alias("z"),
        F.when(k % 5 == 4, "1.2.3").otherwise(F.concat(F.lit("45."), F.lpad((k % 1000).cast("string"), 3, "0"))).alias("lat"),
    )
    marker = _ten_to_a_page(rows, "c_custkey", template("{lat} | -94.{c} | {c_name}&#8217;s\n"), '[nectar_gmap map_markers="', '"]', "https://m.example.com/")
    text = _ten_to_a_page(
        rows,
        "c_custkey",
        template(
            "<p>{c_name}’s\n 218-555-{c}\n {c_custkey}1 Oak Street, Elk River, MN {z} "
            "Website | https://c{c_custkey}.example.com/ c{c_custkey}@example.com Docks &amp; Lifts</p>"
        ),
        "",
        "",
        "",
    )
    # A section ends at a line that opens with a letter, so the facts stand on lines that open with digits.
    joined = marker.join(text.select("page_id", F.col("html").alias("body")), "page_id")
    return joined.select("page_id", "url", F.concat("html", "body").alias("html"))


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortcode pages listing ten suppliers each: name, address, phone, website label and link.

    A coordinate section closes the page: one point per supplier under its own name, one for a branch and
    one for a stranger.
    """
    rows = _located(spark, sf_dir)
    cell = "[vc_column_text]{}[/vc_column_text]"
    listing = F.concat(
        template(cell.format("{s_name} {trade}")),
        template(cell.format("\n<p></p>\n")),
        template(cell.format('<a href="https://www.google.com/maps/p/{s_suppkey}">{s_suppkey}2 Oak Street<br />\nElk River, MN {z}</a>')),
        template(cell.format("218-555-{c}")),
        template(cell.format("Website")),
        F.when(F.col("s_suppkey") % 3 == 0, template(cell.format('<a href="https://s{s_suppkey}.example.org">Visit us</a>'))).otherwise(
            template(cell.format("<a href='https://www.google.com/maps/x'>Visit us</a>"))
        ),
        template(cell.format("Email")),
    )
    points = template("45.{d} | -94.{d} | {s_name}<br />46.{d} | -95.{d} | North {trade} of {s_name}1x<br />47.{d} | -96.{d} | Zq{c}<br />")
    head = "[vc_row][vc_column_text]Website[/vc_column_text][vc_column_text]Contact us[/vc_column_text]"
    listed = _ten_to_a_page(rows, "s_suppkey", listing, head, "", "https://d.example.com/")
    located = _ten_to_a_page(rows, "s_suppkey", points, "[vc_column_text]", "[/vc_column_text]", "")
    joined = listed.join(located.select("page_id", F.col("html").alias("tail")), "page_id")
    return joined.select("page_id", "url", F.concat("html", "tail").alias("html"))


def directory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw directory texts of ten suppliers each: a table row per supplier, and a map with every second
    supplier again in other letters plus one only the map knows."""
    rows = _located(spark, sf_dir)
    row = template(
        "[vc_row_inner a=\"1\"][vc_column_text]{s_name}[/vc_column_text][vc_column_text]{s_suppkey} Elm St, Elk, MN {z}[/vc_column_text]"
        "[vc_column_text]218-555-{c}[/vc_column_text][vc_column_text]{trade} &amp; more[/vc_column_text][/vc_row_inner]"
        "[vc_row_inner][divider]218-555-{c} Supplier lines that are only a divider between two of the rows of this long table here[/vc_row_inner]"
    )
    even = F.col("s_suppkey") % 2 == 0
    marker = F.concat(
        F.when(even, template("45.{d} | -94.{d} | {s_name} <br>218-555-{c}<br />{s_suppkey} Elm St<br>Elk, MN {z}\n")).otherwise(""),
        F.when(~even, template("46.{d} | -95.{d} | Map {s_name} {trade}<br>Elk, MN {z}<br>9 Elm Street<br/>Ely, MN {z}\n")).otherwise(""),
        F.lit("47.1 | -96.1 | short\n"),
    )
    tables = _ten_to_a_page(rows, "s_suppkey", row, "", "", "")
    maps = _ten_to_a_page(rows, "s_suppkey", F.lower(marker), "map_markers=&#8221;", "&#8221;", "")
    return tables.join(maps.select("page_id", F.col("html").alias("map")), "page_id").select(
        "page_id", F.concat("html", "map").alias("text")
    )


def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with ten suppliers each as HTML listing cards."""
    card = template(
        '<div class="Dealer-Card x">\n<b>{s_name}</b>\n<br>\n<p>218-555-{c}\n{s_suppkey} Elm St\nElk, MN {z}\n{trade} service\n'
        'open daily</p><script>x\ny</script></div><div class="note">no\nlisting</div>'
    )
    return _ten_to_a_page(_located(spark, sf_dir), "s_suppkey", card, '<section class="list">', "</section>", "https://b.example.com/")


def gallery_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with two images for each of ten customers, every third without a text."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    alt = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(template(' alt="{c_name}"'))
    piece = F.concat(template('<img src="/big/{c_custkey}.png" alt="Big {c_name}"><IMG src="/small/{c_custkey}.png"'), alt, F.lit(">"))
    return _ten_to_a_page(customer, "c_custkey", piece, "<main>", "</main>", "https://g.example.com/")


def type_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type maps of ten customers each: plain, hidden, blocked, malformed, nameless and default types."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    k = F.col("c_custkey")
    entry = (
        F.when(k % 10 == 0, F.lit('"page":{"rest_base":"sheets"}'))
        .when(k % 10 == 1, F.lit('"b":{"rest_base":"blocks","viewable":true}'))
        .when(k % 10 == 2, F.concat(F.lit('"t'), k.cast("string"), F.lit('":{"rest_base":"x(?P<id>)"}')))
        .when(k % 10 == 3, F.lit('"n":{"viewable":true}'))
        .when(k % 10 == 4, F.concat(F.lit('"h":{"rest_base":"hidden-'), k.cast("string"), F.lit('","viewable":false}')))
        .otherwise(F.concat(F.lit('"t'), k.cast("string"), F.lit('":{"rest_base":"kind-'), k.cast("string"), F.lit('","viewable":true}')))
    )
    keyed = customer.select(F.floor(k / PER_PAGE).cast("bigint").alias("site"), F.struct("c_custkey", entry.alias("entry")).alias("p"))
    grouped = keyed.groupBy("site").agg(F.sort_array(F.collect_list("p"))["entry"].alias("entries"))
    return grouped.select(F.col("site").cast("string").alias("site"), F.concat(F.lit("{"), F.array_join("entries", ","), F.lit("}")).alias("types_json"))


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as landed items: even ids are pages, odd ones posts; every seventh item is blank."""
    blank = F.col("page_id") % 7 == 0
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    rendered = lambda c: F.struct(c.alias("rendered"))
    return pages(spark, sf_dir).select(
        F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("site"),
        F.when(F.col("page_id") % 2 == 0, "pages").otherwise("posts").alias("rest_base"),
        F.col("page_id").alias("id"),
        F.col("page_id").alias("pos"),
        F.when(F.col("page_id") % 5 != 0, F.regexp_extract("url", "^[a-z]+://[^/?#]*/(?:[^?#]*/)?([^/?#]+)", 1)).otherwise("").alias("slug"),
        rendered(F.when(blank, F.lit("  ")).otherwise(title)).alias("title"),
        rendered(F.when(blank, F.lit("")).otherwise(F.col("html"))).alias("content"),
        rendered(F.lit(None).cast("string")).alias("excerpt"),
        F.col("url").alias("link"),
        F.lit("publish").alias("status"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("timestamp").alias("date"),
        F.lit(None).cast("timestamp").alias("modified"),
        F.lit(None).cast("bigint").alias("author"),
        F.lit(None).cast("string").alias("yoast_head"),
        F.lit(None).cast("string").alias("rankmath_head"),
    )


def part_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as media entries; file names repeat within a brand, some entries have no source."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    source = (
        F.when(F.col("p_size") % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("p_size") % 11 == 1, template("https://cdn.example.com/{p_size}/"))
        .otherwise(F.concat(F.lit("https://cdn.example.com/a.b/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit(".png?x=1")))
    )
    return part.select(
        F.col("p_brand").alias("site"),
        F.col("p_partkey").alias("pos"),
        F.col("p_partkey").alias("id"),
        source.alias("source_url"),
        F.col("p_size").cast("bigint").alias("post"),
        F.col("p_name").alias("alt_text"),
        F.lit(None).cast("string").alias("title"),
    )
