from __future__ import annotations

import html
import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions import forms, stats
from pageloom.functions import text as X

T = "t"


@pytest.mark.parametrize("seed", [1, 2])
def test_decode_entities_equals_the_standard_library(spark, seed):
    rng = random.Random(seed)
    bits = ["&", "&amp", "&amp;", "&lt;", "&eacute;", "&notit;", "&#8217;", "&#x2019", "&#128;", "&#0;", "&#xD800;", "&copy2",
            "&bogus;", "&#99999999999;", "&#1;", "&&amp;lt;", "&nbsp;", "&NotEqualTilde;", "&#;", "&#x;", "é", " ", ";", "a", "\n", "😀"]
    cases = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(400)]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", X.decode_entities(F.col("t")).alias("d"))
    for row in got.collect():
        assert row.d == html.unescape(row.t), row.t


def test_decode_all_and_null(spark):
    row = spark.range(1).select(X.decode_all(F.lit("&lt;"), F.lit(None).cast("string")).alias("x")).first()
    assert row.x == ["<", None]


def test_strip_squash_words(value):
    assert value(X.strip(F.col(T)), " \n a b \t") == "a b"
    assert value(X.squash(F.col(T)), " a\n\n b c ") == "a b c"
    assert value(X.word_count(F.col(T)), "") == 0
    assert value(X.word_count(F.col(T)), " one  two\nthree ") == 3
    assert value(X.word_tokens(F.col(T)), "Él no_1, x-y") == ["él", "no_1", "x", "y"]


def test_sub_each(value):
    assert value(X.sub_each(F.col(T), "[0-9]+", lambda m: F.lpad(m, 3, "0")), "1a22b") == "001a022b"
    assert value(X.sub_each(F.col(T), "[0-9]+", F.upper), "none") == "none"


def test_urls(value):
    assert value(X.site_key(F.col(T)), "http://Ex.test:80/a") == "ex.test:80"
    assert value(X.slug(F.col(T)), "http://e.test/a/b/?q") == "b"
    assert value(X.slug(F.col(T)), "http://e.test") == "home"
    assert value(X.absolute(F.lit("//c/d"), F.col(T)), "https://e.test/x") == "https://c/d"
    assert value(X.absolute(F.lit("/d"), F.col(T)), "https://e.test/x") == "https://e.test/d"
    assert value(X.absolute(F.lit("d"), F.col(T)), "https://e.test/x") == "d"
    assert value(X.site_folder(F.col(T), F.lit("")), "Joe's  Shop - & Co.") == "Joes-Shop-Co"


def test_attribute_takes_either_quote_and_not_a_longer_name(value):
    tag = """<img data-src="no" SRC = 'a "b"' alt="">"""
    assert value(X.attribute(F.col(T), "src"), tag) == 'a "b"'
    assert value(X.attribute(F.col(T), "alt"), tag) == ""
    assert value(X.attribute(F.col(T), "title"), tag) is None


def test_preview(value):
    assert value(X.preview(F.col(T), 3), "abcd") == "abc..."
    assert value(X.preview(F.col(T), 4), "abcd") == "abcd"


def test_raw_text(value):
    assert value(forms.raw_text(F.col(T)), "<p>A<br>B</p><script>x</script>") == "A\nB"
    assert value(forms.raw_text(F.col(T)), "<li>a</li><li>b &amp; c</li>\n\n\n<i>d</i>") == "a\nb &amp; c\n\nd"


def test_link_text(value):
    assert value(forms.link_text(F.col(T)), '<h2>Hi</h2><a href="/u"><b>Go</b></a> &lt;i&gt;x') == "[H2] HiGo | /u x"
    assert value(forms.link_text(F.col(T)), "<a href=' /u '> <div>A</div><br>B </a>") == "AB | /u"
    assert value(forms.link_text(F.col(T)), None) == ""
    assert value(forms.link_text(F.col(T)), "a<style>b{}</style><noscript>n</noscript><p>x</p>  y") == "ax\ny"


def test_drop_shortcodes_keeps_contents_and_heading_marks(value):
    drop = forms.drop_shortcodes(F.col(T))
    assert value(drop, '[vc_row a="1"]Keep[/vc_row][divider]') == "Keep"
    assert value(drop, "[vc_raw_html]JTND[/vc_raw_html]a[H2] b") == "a[H2] b"
    assert value(drop, '[gallery ids="1,2"]x[/gallery][et_pb_text]y[/et_pb_text][elementor-template id="3"]') == "xy"
    assert value(drop, "[Size 3] stays") == "[Size 3] stays"


def test_directory_text(value):
    pretty = forms.directory_text(F.col(T))
    assert value(pretty, "Call 2185550123") == "Call\n218-555-0123"
    assert value(pretty, "1-218-555-0123 x") == "218-555-0123 x"
    assert value(pretty, "Elk, MN 56515-1234\nnext") == "Elk, MN 56515-1234\nnext"
    assert value(pretty, "Elk, MN 56515 next") == "Elk, MN 56515\n next"
    assert value(pretty, "a  \r\n\r\n\r\n\r\nb Website | u") == "a\n\nb\nWebsite | u"
    assert value(pretty, "x 46.1 | -95.2 | Shop\nhttps://www.google.com/maps/p y") == "x\n[Google Maps Link] y"


def test_markdown(value):
    md = forms.markdown(F.col(T), F.lit("Top"), F.lit(""))
    assert value(md, "Our Team\n\nsee you there.") == "# Top\n\n## Our Team\n\nsee you there."
    assert value(md, "") == ""
    plain = forms.markdown(F.col(T), F.lit(""), F.lit("http://u"))
    assert value(plain, "a long line.\n\n\nb\nHead") == (
        "**Source:** [http://u](http://u)\n\n---\n\na long line.\n\nb\n\n## Head\n"
    )


def test_markdown_line_decorations(value):
    line = forms.markdown_line(F.col(T))
    assert value(line, "call 218-555-0123") == "📞 **Phone:** call 218-555-0123"
    assert value(line, "Website | http://x.test") == "🌐 **Website:** [http://x.test](http://x.test)"
    assert value(line, "mail a@b.test or 218-555-0123") == "✉️ **Email:** [a@b.test](mailto:a@b.test)"
    assert value(line, "at Elk River, MN 56515") == "📍 **Address:** at Elk River, MN 56515"


def test_listing_block(value):
    block = forms.listing_block(F.array(F.struct(F.col(T).alias("name"))))
    assert value(block, "A").endswith('[{"name":"A"}]')
    assert value(forms.listing_block(F.filter(F.array(F.col(T)), lambda x: x == "none")), "A") == ""


def test_counts(value):
    assert value(stats.line_count(F.col(T)), "") == 0
    assert value(stats.line_count(F.col(T)), "a\nb\n") == 2
    assert value(stats.line_count(F.col(T)), "a\r\nb\n\n") == 3
    assert value(stats.sentence_pieces(F.col(T)), "a b. c") == 2
    assert value(stats.sentence_pieces(F.col(T)), "a.") == 2
    assert value(stats.filled_sentences(F.col(T)), "a?! . b") == 2


def plain_syllables(word: str) -> int:
    runs, before = 0, False
    for char in word.lower():
        now = char in "aeiouy"
        runs += now and not before
        before = now
    if word.lower().endswith("e") and runs > 1:
        runs -= 1
    return max(1, runs)


def test_syllables_equal_the_word_by_word_count(spark):
    import re

    rng = random.Random(3)
    letters = "aeiouybcdfgkmst  \n.-'é"
    cases = ["queue the table", "", "e ee eee bee a-e"] + ["".join(rng.choices(letters, k=80)) for _ in range(200)]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(
        "t", stats.spaced_syllables(F.col("t")).alias("s"), stats.token_syllables(F.col("t")).alias("w")
    )
    for row in got.collect():
        assert row.s == sum(map(plain_syllables, row.t.split())), row.t
        assert row.w == sum(map(plain_syllables, re.findall(r"\w+", row.t))), row.t


def test_long_runs_without_a_break_stay_fast(spark):
    text = "x1" * 200_000
    row = spark.createDataFrame([(text,)], "t string").select(
        stats.spaced_syllables(F.col("t")).alias("s"),
        X.strip(F.col("t")).alias("p"),
        F.col("t").rlike(__import__("pageloom.functions.patterns", fromlist=["EMAIL"]).EMAIL).alias("m"),
    )
    assert row.first().s == 1
