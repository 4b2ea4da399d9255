"""SQL counterparts of the catalog's queries, over the same tables.

Where a query reads pages written from star-schema columns, its SQL reads those columns and knows nothing of
the markup. The others spell the definition out in set form.
"""

from __future__ import annotations

from pageloom.functions import fixed

STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
SITE = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
AUTHORITY = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
WS = "E' \\t\\n\\r\\f\\x0b'"
TOKEN = r"[\p{L}\p{N}_]+"
TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
ADDRESS_TEST = r"[A-Z][a-zA-Z\s]+,\s*[A-Z]{2}\s*\d{5}"


def sub(text: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', E'{new}', 'g')"


def decoded(text: str) -> str:
    """The references the driver pages use."""
    for ref, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = sub(text, f"&{ref};?", char)
    return text


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN}')"


def spaced(text: str) -> str:
    return rf"regexp_extract_all({text}, '\S+')"


def syllables(words: str) -> str:
    groups = "len(regexp_extract_all(lower(w), '[aeiouy]+'))"
    one = f"greatest(1, {groups} - CASE WHEN lower(w) LIKE '%e' AND {groups} > 1 THEN 1 ELSE 0 END)"
    return f"coalesce(list_sum(list_transform({words}, lambda w: {one})), 0)"


def ease(words: str, sentences: str, syllable: str) -> str:
    formula = (
        f"206.835::DOUBLE - (1.015::DOUBLE * ({words}::DOUBLE / {sentences}))"
        f" - (84.6::DOUBLE * ({syllable}::DOUBLE / {words}))"
    )
    return f"CASE WHEN {words} > 0 AND {sentences} > 0 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, {formula})) ELSE 0.0::DOUBLE END"


VISIBLE = decoded(sub("html", "<[^>]+>"))

RAW = "trim(" + sub(
    sub(
        sub(
            sub("html", "(?is)<script.*?</script>|<style.*?</style>"),
            "(?i)<br\\s*/?>|</(?:p|div|li|h[1-6])>",
            "\\n",
        ),
        "<[^>]+>",
    ),
    "\\n{3,}",
    "\\n\\n",
) + f", {WS})"


def _link_text() -> str:
    text = sub(decoded("html"), "(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>")
    text = sub(text, '(?is)<a\\s[^>]*href="([^"]+)"[^>]*>(.*?)</a>', "\\\\2 | \\\\1")
    for n in range(1, 7):
        text = sub(text, f"(?is)<h{n}[^>]*>(.*?)</h{n}>", f"[H{n}] \\\\1")
    text = sub(text, "(?i)<br\\s*/?>|</(?:p|div|li|article|section|header|footer|nav|main)>", "\\n")
    text = sub(sub(sub(text, "<[^>]+>"), "\\r?\\n[ \\t]+", "\\n"), "[ \\t]+\\r?\\n", "\\n")
    return f"trim({sub(text, chr(92) + 'n{3,}', chr(92) + 'n' + chr(92) + 'n')}, {WS})"


LINK_TEXT = _link_text()

SQL: dict[str, str] = {}

# --- pages ------------------------------------------------------------------------------------

SQL["page_titles"] = f"""
WITH t AS (SELECT page_id, {SITE} AS site, {decoded(f"trim({TITLE}, {WS})")} AS title FROM pages)
SELECT page_id, site, title, length(title) AS length, len({spaced('title')}) AS word_count,
       contains(lower(title), 'the') OR contains(lower(title), 'lift') AS has_brand,
       length(title) BETWEEN 30 AND 60 AS optimal_length
FROM t"""

SQL["page_meta_tags"] = """
SELECT p_partkey AS page_id, concat(p_name, ' &amp; ', p_brand, ' of ', p_type) AS meta_title,
       concat(p_name, '''s page > ', p_brand) AS meta_description, concat(p_type, ', ', p_brand) AS meta_keywords,
       p_name AS og_title, '' AS og_description,
       CASE WHEN p_size % 2 = 1 THEN concat('/img/', p_partkey, '.png') ELSE '' END AS og_image,
       concat('https://shop.example.com/p/', p_partkey) AS canonical_url,
       CASE WHEN p_size % 2 = 1 THEN 'noindex' ELSE '' END AS robots, 'summary' AS twitter_card
FROM part"""

SQL["page_meta_description"] = """
WITH d AS (SELECT p_partkey AS page_id, concat(p_name, '''s page > ', p_brand) AS description FROM part)
SELECT page_id, description, length(description) AS length, len(string_split(description, ' ')) AS word_count,
       length(description) BETWEEN 120 AND 160 AS optimal_length
FROM d"""

SQL["page_headings"] = f"""
WITH h AS (
  SELECT page_id, {SITE} AS site, n AS level, unnest(b) AS body, unnest(range(len(b))) AS i
  FROM (SELECT page_id, url, n, regexp_extract_all(html, concat('(?is)<h', n, '[^>]*>(.*?)</h', n, '>'), 1) AS b
        FROM pages, range(1, 7) AS levels(n))),
t AS (SELECT page_id, site, level, i, {decoded(f"trim({sub('body', '<[^>]+>')}, {WS})")} AS text FROM h)
SELECT page_id, site, row_number() OVER (PARTITION BY page_id ORDER BY level, i) - 1 AS pos, level, text,
       length(text) AS length, len({spaced('text')}) AS word_count, text = '' AS is_empty
FROM t"""

SQL["product_headings"] = r"""
WITH h AS (
  SELECT p_partkey AS page_id, 0 AS pos, 1 AS level, p_name AS text FROM part
  UNION ALL SELECT p_partkey, 1, 2, concat(p_brand, ' & co') FROM part
  UNION ALL SELECT p_partkey, 2, CASE WHEN p_size % 2 = 1 THEN 3 ELSE 4 END, p_type FROM part
  UNION ALL SELECT p_partkey, 3, 5, '' FROM part)
SELECT page_id, pos, level, text, length(text) AS length, len(regexp_extract_all(text, '\S+')) AS word_count, text = '' AS is_empty
FROM h"""

SQL["listed_headings"] = """
SELECT p_partkey AS page_id, 'H1' AS level, p_name AS text FROM part
UNION ALL SELECT p_partkey, 'H2', concat(p_brand, ' &amp; co') FROM part
UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'H3' ELSE 'H4' END, p_type FROM part"""

SQL["heading_hierarchy"] = """
SELECT p_partkey AS page_id, 1 AS h1_count, 1 AS h2_count, p_size % 2 AS h3_count, 1 - p_size % 2 AS h4_count,
       1 AS h5_count, 0 AS h6_count, 4 AS total_headings, false AS has_proper_hierarchy
FROM part"""

_ANCHORS = """
anchors AS (
  SELECT page_id, url AS page_url, unnest(a) AS a, unnest(range(len(a))) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS a FROM pages))"""

SQL["page_links"] = f"""
WITH {_ANCHORS}
SELECT page_id, lower(regexp_extract(page_url, '^[a-z]+://([^/?#]*)', 1)) AS site, pos, url, text,
       CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'external' ELSE 'internal' END AS link_type
FROM (SELECT page_id, page_url, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS url,
             trim({sub('a', '<[^>]+>')}, {WS}) AS text FROM anchors)
WHERE url <> '' AND text <> ''"""

_CUSTOMER_LINKS = """
links AS (
  SELECT c_custkey AS page_id, n.site, l.pos, l.url, l.anchor_text
  FROM customer, LATERAL (SELECT concat('n', c_nationkey, '.example.com') AS site) n, LATERAL (VALUES
    (0, concat('/c/', c_custkey), c_name),
    (1, concat('https://', n.site, '/home'), 'Home & more'),
    (2, concat('tel:555', c_custkey), 'call'),
    (3, concat('http://', c_mktsegment, '.example.net/a?b=1'), c_mktsegment),
    (4, concat('https://www.facebook.com/', c_custkey), ''),
    (5, '', 'empty')) l(pos, url, anchor_text))"""

SQL["link_type_counts"] = f"""
WITH {_CUSTOMER_LINKS}
SELECT site, CASE WHEN url LIKE 'http%' THEN 'external' ELSE 'internal' END AS link_type, count(*) AS links
FROM links WHERE url <> '' AND anchor_text <> '' GROUP BY ALL"""

SQL["links_by_scope"] = f"""
WITH {_CUSTOMER_LINKS}
SELECT page_id, pos, url, anchor_text, length(anchor_text) AS anchor_length,
       regexp_extract(url, '^https?://([^/]*)', 1) AS domain,
       CASE WHEN pos IN (3, 4) THEN 'external' ELSE 'internal' END AS scope, pos IN (4, 5) AS is_empty
FROM links"""

SQL["internal_links"] = f"""
WITH {_CUSTOMER_LINKS}
SELECT page_id, pos, url, anchor_text, length(anchor_text) AS anchor_length FROM links WHERE pos NOT IN (3, 4)"""

SQL["external_domains"] = f"""
WITH {_CUSTOMER_LINKS}
SELECT site, regexp_extract(url, '^https?://([^/]*)', 1) AS domain, count(*) AS links
FROM links WHERE pos IN (3, 4) GROUP BY ALL"""

_PART_IMAGES = """
images AS (
  SELECT p_partkey AS page_id, 0 AS pos, concat('/img/', p_partkey, '.png') AS src,
         concat('https://shop.example.com/img/', p_partkey, '.png') AS url, p_name AS alt, p_brand AS title, true AS has_alt FROM part
  UNION ALL
  SELECT p_partkey, 1, CASE WHEN p_size % 2 = 1 THEN concat('//cdn.example.com/', p_partkey, '.jpg') ELSE concat('https://cdn.example.com/', p_partkey, '.gif') END,
         CASE WHEN p_size % 2 = 1 THEN concat('https://cdn.example.com/', p_partkey, '.jpg') ELSE concat('https://cdn.example.com/', p_partkey, '.gif') END,
         '', '', p_size % 2 = 1 FROM part)"""

SQL["image_alt_audit"] = f"""
WITH {_PART_IMAGES}
SELECT page_id, pos, src, url, alt, title, has_alt, length(alt) AS alt_length FROM images"""

SQL["first_ten_images"] = """
WITH i AS (SELECT c_custkey // 10 AS page_id, c_custkey AS k, c_name, n.v AS n,
  row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY c_custkey, n.v) - 1 AS pos FROM customer, (VALUES (0), (1)) n(v))
SELECT page_id, pos, concat(CASE n WHEN 0 THEN '/big/' ELSE '/small/' END, k, '.png') AS src,
  CASE WHEN n = 0 THEN concat('Big ', c_name) WHEN k % 3 = 0 THEN '' ELSE c_name END AS alt, n = 0 OR k % 3 <> 0 AS has_alt FROM i WHERE pos < 10"""

SQL["first_images"] = f"""
WITH {_PART_IMAGES}
SELECT page_id, pos, src, alt, has_alt FROM images WHERE pos = 0"""

SQL["page_media"] = f"""
WITH {_PART_IMAGES}
SELECT page_id, pos, 'image' AS kind, 1 AS pattern_no, url AS src, alt FROM images
UNION ALL SELECT p_partkey, 2, 'video', 1, concat('https://shop.example.com/v/', p_partkey, '.mp4'), '' FROM part
UNION ALL SELECT p_partkey, 3, 'video', CASE WHEN p_size % 2 = 1 THEN 2 ELSE 3 END,
  CASE WHEN p_size % 2 = 1 THEN concat('https://www.youtube.com/embed/', p_partkey) ELSE concat('https://cdn.example.com/video-', p_partkey, '.swf') END, '' FROM part
UNION ALL SELECT p_partkey, 4, 'audio', 1, concat('https://shop.example.com/a/', p_partkey, '.mp3'), '' FROM part"""

SQL["page_forms"] = """
SELECT s_suppkey AS page_id, 0 AS form_no, concat('/order/', s_suppkey) AS action, 'POST' AS method, 4 AS n_fields FROM supplier
UNION ALL SELECT s_suppkey, 1, '', 'GET', 1 FROM supplier"""

SQL["form_fields"] = """
SELECT s_suppkey AS page_id, f.form_no, f.pos, f.name, f.type
FROM supplier, LATERAL (VALUES
  (0, 0, concat('mail_', s_nationkey), 'email'), (0, 1, 'qty', 'text'), (0, 2, concat('note_', s_suppkey), 'text'),
  (0, 3, concat('nation_', s_nationkey), 'text'), (1, 0, s_name, 'search')) f(form_no, pos, name, type)"""

SQL["structured_data"] = """
SELECT event_id AS page_id, 0 AS pos, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""

_METRICS = f"""
metrics AS (
  SELECT page_id, len({spaced('text')}) AS word_count, length(text) AS character_count,
    len(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>.*?</p>')) AS paragraph_count,
    len(list_filter(regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda b: trim({sub('b', '<[^>]+>')}, {WS}) <> '')) AS heading_count,
    len(list_filter(regexp_extract_all(html, '(?is)<a\\s[^>]*href="[^"]+"[^>]*>.*?</a>'), lambda b: trim({sub('b', '<[^>]+>')}, {WS}) <> '')) AS link_count,
    len(regexp_extract_all(html, '(?i)<img[^>]*>')) AS image_count, text, html, url
  FROM (SELECT page_id, url, html, {LINK_TEXT} AS text FROM pages))"""

SQL["page_metrics"] = f"""
WITH {_METRICS}
SELECT page_id, word_count, character_count, paragraph_count, heading_count, link_count, image_count FROM metrics"""

SQL["page_previews"] = f"""
SELECT page_id, CASE WHEN length(html) > 1000 THEN concat(substr(html, 1, 1000), '...') ELSE html END AS html,
  CASE WHEN length(text) > 1000 THEN concat(substr(text, 1, 1000), '...') ELSE text END AS text
FROM (SELECT page_id, html, {LINK_TEXT} AS text FROM pages)"""

# --- tokens and figures -----------------------------------------------------------------------

SQL["word_counts"] = f"SELECT page_id, len({tokens(VISIBLE)}) AS word_count FROM pages"


def _token_rows(source: str, key: str, text: str) -> str:
    return f"""
tk AS (SELECT {key} AS page_id, {tokens(text)} AS t FROM {source}),
tokens AS (SELECT page_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM tk)"""


SQL["tokens"] = f"""
WITH {_token_rows('documents', 'doc_id', 'text')}
SELECT page_id, pos, token FROM tokens"""

SQL["sentences"] = r"""
WITH s AS (SELECT doc_id AS page_id, regexp_split_to_array(text, '[.!?]+') AS p FROM documents)
SELECT page_id, pos, sentence, NOT regexp_matches(sentence, '\S') AS is_blank
FROM (SELECT page_id, unnest(p) AS sentence, unnest(range(len(p))) AS pos FROM s)"""


def _top(terms: str, k: int, columns: str) -> str:
    """Rank terms of (page_id, term, pos) by frequency, ties by first position."""
    return f"""
counted AS (SELECT page_id, term, count(*) AS n, min(pos) AS first_pos FROM {terms} GROUP BY page_id, term),
ranked AS (SELECT page_id, term, n, sum(n) OVER (PARTITION BY page_id)::BIGINT AS total,
                  row_number() OVER (PARTITION BY page_id ORDER BY n DESC, first_pos) AS rank FROM counted)
SELECT {columns} FROM ranked WHERE rank <= {k}"""


_KEYWORDS = f"kw AS (SELECT page_id, token AS term, pos FROM tokens WHERE length(token) > 2 AND token NOT IN ({STOP}))"


def _grams(n: int) -> str:
    leads = "".join(f", lead(token, {k}) OVER w AS t{k}" for k in range(1, n))
    names = ", ".join(["token"] + [f"t{k}" for k in range(1, n)])
    clean = " AND ".join([f"token NOT IN ({STOP})"] + [f"t{k} IS NOT NULL AND t{k} NOT IN ({STOP})" for k in range(1, n)])
    return f"""
l{n} AS (SELECT page_id, pos, token{leads} FROM tokens WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
g{n} AS (SELECT page_id, pos, concat_ws(' ', {names}) AS term FROM l{n} WHERE {clean})"""


SQL["keyword_top20"] = f"""
WITH {_token_rows('pages', 'page_id', VISIBLE)}, {_KEYWORDS},
{_top('kw', 20, 'page_id, rank, term, n, total, round(n / total * 100, 2) AS pct')}"""

SQL["bigram_top10"] = f"""
WITH {_token_rows('pages', 'page_id', VISIBLE)}, {_grams(2)},
{_top('g2', 10, 'page_id, rank, term, n')}"""

SQL["trigram_top5"] = f"""
WITH {_token_rows('documents', 'doc_id', 'text')}, {_grams(3)},
{_top('g3', 5, 'page_id, rank, term, n')}"""

SQL["keyword_density"] = f"""
WITH {_token_rows('pages', 'page_id', VISIBLE)}, {_KEYWORDS}, {_grams(2)}, {_grams(3)},
totals AS (SELECT tk.page_id, count(kw.term) AS total_words FROM tk LEFT JOIN kw USING (page_id) GROUP BY tk.page_id),
every AS (SELECT 'keyword' AS kind, 20 AS k, * FROM kw UNION ALL SELECT 'bigram', 10, page_id, term, pos FROM g2
          UNION ALL SELECT 'trigram', 5, page_id, term, pos FROM g3),
counted AS (SELECT page_id, kind, k, term, count(*) AS n, min(pos) AS first_pos FROM every GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY n DESC, first_pos) AS rank FROM counted)
SELECT page_id, total_words, kind, rank, term, n FROM ranked JOIN totals USING (page_id) WHERE rank <= k"""

SQL["top_words"] = f"""
WITH {_token_rows('documents', 'doc_id', 'text')},
w AS (SELECT page_id, token AS term, pos FROM tokens WHERE regexp_full_match(token, '[a-z]+')),
{_top('w', 20, 'page_id, rank, term, n')}"""


def _figures(source: str, key: str, text: str, more: str = "") -> str:
    return f"""
f0 AS (SELECT {key} AS page_id, {text} AS text{more} FROM {source}),
f1 AS (SELECT *, {spaced('text')} AS words, regexp_split_to_array(text, '[.!?]+') AS pieces FROM f0),
f2 AS (SELECT *, len(words) AS word_count, length(text) AS character_count,
         CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), E'\\n')) END AS line_count,
         len(pieces) AS sentence_count,
         list_sum(list_transform(pieces, lambda p: len({spaced('p')}))) AS in_sentences,
         {syllables('words')} AS syllable_count FROM f1),
figures AS (SELECT *, {ease('word_count', 'sentence_count', 'syllable_count')} AS score FROM f2)"""


SQL["text_stats"] = f"""
WITH {_figures('documents', 'doc_id', 'text')}
SELECT page_id, word_count, character_count, line_count, sentence_count,
       round(in_sentences / sentence_count, 2) AS avg_sentence_length, round(score, 6) AS readability_score
FROM figures WHERE text <> ''"""

SQL["readability_corpus"] = f"""
WITH {_figures('pages', 'page_id', VISIBLE)}
SELECT page_id, round(score, 6) AS readability_score FROM figures WHERE text <> ''"""

_AUDIT = f"""
p AS (SELECT page_id, {SITE} AS site, {AUTHORITY} AS domain, html, {decoded(f"trim({TITLE}, {WS})")} AS title, {VISIBLE} AS text FROM pages),
q AS (SELECT *, regexp_extract_all(text, '{TOKEN}') AS words,
        len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\\S'))) AS sentences,
        len(regexp_extract_all(html, '(?is)<h1[^>]*>.*?</h1>')) AS h1_count,
        regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1) AS urls FROM p),
r AS (SELECT *, len(words) AS n, {syllables('words')} AS sy, len({tokens('text')}) AS word_count,
        len(list_filter(urls, lambda u: u LIKE 'http%' AND NOT contains(u, domain))) AS external_links FROM q),
e AS (SELECT *, {ease('n', 'sentences', 'sy')} AS ease, len(urls) - external_links AS internal_links,
        length(title) AS title_length, len({spaced('title')}) AS title_words FROM r),
facts AS (SELECT page_id, site, title, title_length, title_words, 0 AS description_length, h1_count, h1_count AS total_headings,
        h1_count = 1 AS has_proper_hierarchy, word_count, internal_links, external_links, 0 AS total_images, 0 AS images_with_alt,
        0 AS images_without_alt, round(ease, 1) AS flesch_score,
        CASE WHEN n = 0 OR sentences = 0 THEN 'Unknown' WHEN ease >= 90 THEN '5th grade' WHEN ease >= 80 THEN '6th grade'
             WHEN ease >= 70 THEN '7th grade' WHEN ease >= 60 THEN '8th-9th grade' WHEN ease >= 50 THEN '10th-12th grade'
             WHEN ease >= 30 THEN 'College level' ELSE 'Graduate level' END AS grade_level,
        CASE WHEN n > 0 AND sentences > 0 THEN round(n / sentences, 1) END AS avg_sentence_length,
        CASE WHEN n > 0 AND sentences > 0 THEN round(sy / n, 1) END AS avg_syllables_per_word FROM e),
audit AS (SELECT *,
        CASE WHEN title_length BETWEEN 30 AND 60 THEN 15 ELSE 0 END AS title_length_points,
        CASE WHEN title_words >= 3 THEN 5 ELSE 0 END AS title_words_points,
        0 AS description_points,
        CASE WHEN h1_count = 1 THEN 10 ELSE 0 END AS h1_points,
        CASE WHEN has_proper_hierarchy THEN 10 ELSE 0 END AS hierarchy_points,
        CASE WHEN word_count >= 300 THEN 15 WHEN word_count >= 150 THEN 10 ELSE 0 END AS content_points,
        0 AS image_points,
        CASE WHEN flesch_score >= 60 THEN 10 WHEN flesch_score >= 30 THEN 5 ELSE 0 END AS reading_points,
        CASE WHEN internal_links >= 3 THEN 5 ELSE 0 END AS internal_link_points,
        CASE WHEN external_links BETWEEN 1 AND 5 THEN 5 ELSE 0 END AS external_link_points FROM facts),
scored AS (SELECT *, title_length_points + title_words_points + h1_points + hierarchy_points + content_points + reading_points
        + internal_link_points + external_link_points AS seo_score,
        [c FOR c IN [
          CASE WHEN title <> '' AND title_length NOT BETWEEN 30 AND 60 THEN 'title_length' END,
          CASE WHEN title <> '' AND title_words < 3 THEN 'title_few_words' END,
          CASE WHEN title = '' THEN 'title_missing' END,
          'description_missing',
          CASE WHEN h1_count = 0 THEN 'h1_missing' END,
          CASE WHEN h1_count > 1 THEN 'h1_multiple' END,
          CASE WHEN NOT has_proper_hierarchy THEN 'hierarchy_poor' END,
          CASE WHEN word_count < 150 THEN 'content_short' END,
          CASE WHEN flesch_score < 30 THEN 'hard_to_read' END] IF c IS NOT NULL] AS issue_codes,
        [c FOR c IN [
          CASE WHEN title <> '' AND title_length NOT BETWEEN 30 AND 60 THEN 'title_length' END,
          CASE WHEN title = '' THEN 'title_missing' END,
          'description_missing',
          CASE WHEN h1_count = 0 THEN 'h1_missing' END,
          CASE WHEN h1_count > 1 THEN 'h1_multiple' END,
          CASE WHEN NOT has_proper_hierarchy THEN 'hierarchy_poor' END,
          CASE WHEN word_count BETWEEN 150 AND 299 THEN 'content_medium' END,
          CASE WHEN word_count < 150 THEN 'content_short' END,
          CASE WHEN flesch_score >= 30 AND flesch_score < 60 THEN 'fairly_hard_to_read' END,
          CASE WHEN flesch_score < 30 THEN 'hard_to_read' END,
          CASE WHEN internal_links < 3 THEN 'few_internal_links' END,
          CASE WHEN external_links > 5 THEN 'many_external_links' END] IF c IS NOT NULL] AS advice_codes FROM audit)"""

SQL["readability_audit"] = f"""
WITH {_AUDIT}
SELECT page_id, flesch_score, grade_level, avg_sentence_length, avg_syllables_per_word FROM facts"""

# --- text forms -------------------------------------------------------------------------------

SQL["raw_text"] = f"SELECT page_id, {RAW} AS text FROM pages"
SQL["link_text"] = f"SELECT page_id, {LINK_TEXT} AS text FROM pages"
SQL["visible_text"] = f"SELECT page_id, {VISIBLE} AS text FROM pages"
SQL["clean_cells"] = f"SELECT page_id, trim({sub(decoded('html'), chr(92) + 's+', ' ')}, {WS}) AS text FROM pages"

SQL["shortcode_clean"] = """
SELECT p_partkey AS page_id, concat(p_name, ' ', p_brand, ' [H2] kept [Size ', p_size, ']') AS text,
       6 AS visual_composer_count, 0 AS elementor_count, 2 AS divi_count, 1 AS nectar_count, 1 AS divider_count, 1 AS ultimate_count
FROM part"""

_PHONES = """
c AS (SELECT c_custkey AS k, c_name,
        concat(200 + c_custkey % 700, '-', 201 + c_custkey % 797, '-', lpad((c_custkey % 10000)::VARCHAR, 4, '0')) AS phone,
        lpad((c_custkey % 90000 + 10000)::VARCHAR, 5, '0') AS z FROM customer)"""

SQL["pretty_text"] = f"""
WITH {_PHONES}
SELECT k AS page_id, concat(c_name, E'\\nCall\\n', phone, E' now\\n\\nor\\n', phone, E'\\nElk River, MN ', z,
  E'\\n open\\nWebsite | https://c', k, E'.example.com/x\\nmail c', k, E'@example.com today\\nmap\\n[Google Maps Link] end') AS text
FROM c"""

def _lines(source: str, key: str, text: str) -> str:
    """Lines of a text, their class and their markdown."""
    return f"""
doc_lines AS (
  SELECT page_id, unnest(l) AS raw, unnest(range(len(l))) AS line_no
  FROM (SELECT {key} AS page_id, string_split({text}, E'\\n') AS l FROM {source})),
lines AS (SELECT page_id, line_no, trim(raw, {WS}) AS line FROM doc_lines),
classed AS (SELECT *, CASE WHEN line = '' THEN 'blank'
    WHEN length(line) < 60 AND line NOT LIKE '%.' AND line NOT LIKE 'http%' AND NOT regexp_matches(line, '\\d{{3}}-\\d{{3}}-\\d{{4}}')
         AND line[1] = upper(line[1]) AND line[1] <> lower(line[1]) THEN 'heading' ELSE 'text' END AS line_class FROM lines),
m1 AS (SELECT *, CASE WHEN regexp_matches(line, '\\d{{3}}-\\d{{3}}-\\d{{4}}') THEN concat('{fixed.PHONE_MARK}', line) ELSE line END AS s1 FROM classed),
m2 AS (SELECT *, regexp_extract(s1, '{fixed.EMAIL}') AS mail FROM m1),
m3 AS (SELECT *, CASE WHEN mail <> '' THEN concat('{fixed.EMAIL_MARK}[', mail, '](mailto:', mail, ')') ELSE s1 END AS s3 FROM m2),
md AS (SELECT page_id, line_no, line_class, CASE line_class WHEN 'heading' THEN concat('## ', line) WHEN 'blank' THEN ''
    ELSE CASE WHEN regexp_matches(s3, '{ADDRESS_TEST}') THEN concat('{fixed.ADDRESS_MARK}', s3) ELSE s3 END END AS md FROM m3)"""


_LINES = _lines("documents", "doc_id", "text")
#: Marked-up lines put together; the title and source lines stand before them.
_BODY = """
w AS (SELECT *, coalesce(lag(line_class) OVER (PARTITION BY page_id ORDER BY line_no) = 'text', false) AS after_text FROM md),
b AS (SELECT page_id, line_no, CASE WHEN line_class = 'heading' THEN concat(CASE WHEN after_text THEN E'\\n' ELSE '' END, md, E'\\n')
        WHEN line_class = 'text' THEN md WHEN after_text THEN '' END AS block FROM w),
d AS (SELECT page_id, string_agg(block, E'\\n' ORDER BY line_no) AS body FROM b GROUP BY page_id)"""

SQL["markdown_lines"] = f"""
WITH {_LINES}
SELECT page_id, line_no, line_class, md FROM md"""

SQL["markdown_documents"] = f"""
WITH {_LINES}, {_BODY}
SELECT page_id, concat_ws(E'\\n', '# Title', '', concat('**Source:** [https://docs.example.com/', page_id, '](https://docs.example.com/', page_id, ')'),
  '', '---', '', body) AS markdown FROM d"""


def _pretty() -> str:
    """Directory form of the driver pages' text: they hold phones and long numbers, but no map, shortcode or label."""
    text = sub("text", fixed.ANY_PHONE, "\\\\1\\\\2-\\\\3-\\\\4")
    text = sub(text, f"\\n?({fixed.DASHED_PHONE})", "\\n\\\\1")
    text = sub(text, "\\b(\\d{5}(?:-\\d{4})?)\\b\\n?", "\\\\1\\n")
    return f"trim({sub(sub(text, '[ ' + chr(92) + 't]+' + chr(92) + 'n', chr(92) + 'n'), chr(92) + 'n{3,}', chr(92) + 'n' + chr(92) + 'n')}, {WS})"


SQL["page_text_forms"] = f"""
WITH linked AS (SELECT page_id, url, trim(concat('Page ', page_id, E'\\n\\n', {RAW}), {WS}) AS raw_text, {LINK_TEXT} AS text FROM pages),
p AS (SELECT *, {_pretty()} AS pretty FROM linked),
{_lines("p", "page_id", "pretty")}, {_BODY}
SELECT page_id, raw_text, text, trim(concat('Page ', page_id, E'\\n\\n', pretty), {WS}) AS pretty_text,
  CASE WHEN pretty = '' THEN '' ELSE concat_ws(E'\\n', concat('# Page ', page_id), '', concat('**Source:** [', url, '](', url, ')'), '', '---', '', body) END AS markdown
FROM p JOIN d USING (page_id)"""

SQL["page_text_businesses"] = f"""
WITH c AS (SELECT c_custkey AS k, c_custkey // 10 AS page_id, c_name, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS c,
  lpad((c_custkey % 90000 + 10000)::VARCHAR, 5, '0') AS z, CAST(concat('45.', lpad((c_custkey % 1000)::VARCHAR, 3, '0')) AS DOUBLE) AS lat,
  CAST(concat('-94.', lpad((c_custkey % 10000)::VARCHAR, 4, '0')) AS DOUBLE) AS lon FROM customer),
rows AS (SELECT *, concat(c_name, E'’s\\n218-555-', c, E'\\n', k, '1', CASE WHEN length(k::VARCHAR) = 4 THEN E'\\n' ELSE '' END,
    ' Oak Street, Elk River, MN ', z, E'\\n\\nWebsite | https://c', k, '.example.com/ c', k, '@example.com Docks & Lifts') AS shown,
  concat('{{"name":"', c_name, '’s","coordinates":{{"latitude":', lat, ',"longitude":', lon, '}},"phone":"218-555-', c, '","website":"https://c', k,
    '.example.com/","email":"c', k, '@example.com","address":{{"street":"', k, '1 Oak Street","city":"Elk River","state":"MN","zip_code":"', z,
    '"}},"services":["Docks & Lifts"]}}') AS entry FROM c),
p AS (SELECT page_id, string_agg(shown, E'\\n' ORDER BY k) AS body,
  concat('[', string_agg(entry, ',' ORDER BY k) FILTER (k % 5 <> 4), ']') AS json FROM rows GROUP BY page_id)
SELECT page_id, CASE WHEN json = '[]' THEN concat(E'Map\\n\\n', body) ELSE concat_ws(E'\\n', E'Map\\n', body, '', '{fixed.LISTING_RULE}', '{fixed.LISTING_TITLE}', '{fixed.LISTING_RULE}', json) END AS pretty_text,
  json AS last_line FROM p"""

# --- contacts ---------------------------------------------------------------------------------

SQL["contacts_phones"] = " UNION ALL ".join(
    f"""
SELECT page_id, {n} AS pattern_no, value, right({sub('value', chr(92) + 'D')}, 10) AS normalized
FROM (SELECT doc_id AS page_id, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM documents)"""
    for n, pattern in enumerate(fixed.PAGE_PHONES, 1)
)

SQL["contacts_emails"] = f"""
SELECT DISTINCT doc_id AS page_id, unnest(regexp_extract_all(text, '{fixed.EMAIL}')) AS value FROM documents"""



def _corpus_contacts(key: str) -> str:
    kinds = (("phone", fixed.CORPUS_PHONE), ("email", fixed.EMAIL), ("url", r"https?://\S+"))
    return " UNION ".join(
        f"SELECT {key}, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM documents"
        for kind, pattern in kinds
    )


SQL["corpus_contacts"] = _corpus_contacts("doc_id AS page_id")

SQL["contact_urls"] = """
SELECT s_suppkey AS page_id, concat('https://s', s_nationkey, '.example.org/', s_suppkey) AS value FROM supplier
UNION ALL SELECT s_suppkey, 'http://a.example.net' FROM supplier"""

SQL["social_mentions"] = """
SELECT s_suppkey AS page_id, v AS value FROM supplier, (VALUES ('facebook'), ('youtube')) t(v)"""

_ZIP = "lpad((s_suppkey % 90000 + 10000)::VARCHAR, 5, '0')"

SQL["addresses"] = f"""
SELECT s_suppkey AS page_id, 0 AS pos, 'Elk River' AS city, 'MN' AS state, concat({_ZIP}, '-1234') AS zip_code FROM supplier
UNION ALL SELECT s_suppkey, 1, 'Port Wing', 'WI', {_ZIP} FROM supplier"""

SQL["address_strings"] = f"""
SELECT s_suppkey AS page_id, 1 AS pattern_no, concat(s_suppkey, '5 Oak Lane, Elk River, MN ', {_ZIP}, '-1234') AS value FROM supplier
UNION ALL SELECT s_suppkey, 2, concat('Elk River, MN ', {_ZIP}, '-1234') FROM supplier
UNION ALL SELECT s_suppkey, 2, concat('Port Wing, WI ', {_ZIP}) FROM supplier"""

# --- directories ------------------------------------------------------------------------------

_IS_HEADER = f"""(line = upper(line) AND line <> lower(line) AND regexp_matches(line, '\\S\\s+\\S')
    AND NOT regexp_matches(line, '{fixed.PAGE_PHONES[0]}') AND NOT regexp_matches(lower(line), '{fixed.STREET_LINE}'))"""
_SERVICE_TEST = " OR ".join(f"contains(lower(line), '{w}')" for w in fixed.SERVICE_WORDS)

SQL["directory_blocks"] = f"""
WITH {_LINES},
filled AS (SELECT * FROM lines WHERE line <> ''),
marked AS (SELECT *, {_IS_HEADER} AS is_header FROM filled),
islands AS (SELECT *, sum(is_header::INT) OVER (PARTITION BY page_id ORDER BY line_no) AS biz FROM marked),
kinds AS (SELECT *, CASE WHEN is_header THEN 'name' WHEN regexp_matches(line, '{fixed.LISTING_PHONE}') THEN 'phone'
    WHEN regexp_matches(lower(line), '{fixed.STREET_LINE}') THEN 'street' WHEN regexp_matches(line, '{fixed.STATE_ZIP}') THEN 'zip'
    WHEN {_SERVICE_TEST} THEN 'service' ELSE 'other' END AS kind FROM islands WHERE biz > 0),
streets AS (SELECT *, max(CASE WHEN kind = 'street' THEN line_no END) OVER (PARTITION BY page_id, biz) AS last_street FROM kinds)
SELECT page_id, biz - 1 AS pos, max(line) FILTER (kind = 'name') AS name,
  coalesce(string_agg(line, ', ' ORDER BY line_no) FILTER (kind IN ('street', 'zip') AND line_no >= coalesce(last_street, 0)), '') AS address,
  coalesce(arg_max(regexp_extract(line, '{fixed.LISTING_PHONE}'), line_no) FILTER (kind = 'phone'), '') AS phone,
  coalesce(string_agg(line, '|' ORDER BY line_no) FILTER (kind = 'service'), '') AS services,
  coalesce(string_agg(line, '|' ORDER BY line_no) FILTER (kind = 'other'), '') AS other_info
FROM streets GROUP BY page_id, biz"""

_LOCATED = """
located AS (SELECT s_suppkey AS k, s_suppkey // 10 AS page_id, s_name, lpad((s_suppkey % 90000 + 10000)::VARCHAR, 5, '0') AS z,
  lpad((s_suppkey % 10000)::VARCHAR, 4, '0') AS c, lpad((s_suppkey % 1000)::VARCHAR, 3, '0') AS d, s_suppkey % 10 AS i,
  CASE s_suppkey % 4 WHEN 0 THEN 'Dock and Lift' WHEN 1 THEN 'Marine' WHEN 2 THEN 'Trailer Auto' ELSE 'Goods' END AS trade FROM supplier)"""

SQL["directory_sections"] = f"""
WITH {_LOCATED}
SELECT page_id, concat(s_name, ' ', trade) AS name, concat(k, '2 Oak Street, Elk River, MN ', z) AS address,
  concat('https://www.google.com/maps/p/', k) AS address_url, concat('218-555-', c) AS phone,
  CASE WHEN k % 3 = 0 THEN concat('https://s', k, '.example.org') ELSE '' END AS website_url,
  CASE k % 4 WHEN 0 THEN 'docks & lifts' WHEN 1 THEN 'marine' WHEN 2 THEN 'trailers & auto' ELSE '' END AS services
FROM located"""

SQL["shortcode_sections"] = f"""
WITH {_LOCATED}
SELECT page_id, 7 * count(*) + 3 AS sections, 6 * count(*) + 3 AS filled, 7 * count(*) + 3 AS lines FROM located GROUP BY page_id"""

SQL["coordinate_lines"] = f"""
WITH {_LOCATED}
SELECT page_id, 3 * i + p.n AS pos, concat(45 + p.n, '.', d) AS lat, concat('-', 94 + p.n, '.', d) AS lon,
  CASE p.n WHEN 0 THEN s_name WHEN 1 THEN concat('North ', trade, ' of ', s_name, '1x') ELSE concat('Zq', c) END AS name
FROM located, (VALUES (0), (1), (2)) p(n)"""

_MARKERS = """
markers AS (SELECT c_custkey AS k, c_custkey // 10 AS page_id, concat(c_name, '’s') AS name,
  CAST(concat('45.', lpad((c_custkey % 1000)::VARCHAR, 3, '0')) AS DOUBLE) AS lat,
  CAST(concat('-94.', lpad((c_custkey % 10000)::VARCHAR, 4, '0')) AS DOUBLE) AS lon,
  lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS c, lpad((c_custkey % 90000 + 10000)::VARCHAR, 5, '0') AS z
  FROM customer WHERE c_custkey % 5 <> 4)"""

SQL["map_markers"] = f"WITH {_MARKERS} SELECT page_id, name, lat, lon FROM markers"

SQL["business_details"] = f"""
WITH {_MARKERS}
SELECT page_id, name, lat, lon, concat('218-555-', c) AS phone, concat('https://c', k, '.example.com/') AS website,
  concat('c', k, '@example.com') AS email, concat(k, '1 Oak Street') AS street, 'Elk River' AS city, 'MN' AS state, z AS zip_code,
  'Docks & Lifts' AS services FROM markers"""

_TABLE = """
tables AS (SELECT page_id, k, s_name AS name, concat(k, ' Elm St, Elk, MN ', z) AS address,
  concat('https://maps.google.com/?q=', k, '+Elm+St%2C+Elk%2C+MN+', z) AS address_url, concat('218-555-', c) AS phone, '' AS website_url,
  CASE k % 4 WHEN 0 THEN 'docks & lifts' WHEN 2 THEN 'trailers' ELSE 'docks & lifts' END AS services, 'table_format' AS source FROM located)"""

_MAP = """
maps AS (SELECT page_id, k, CASE WHEN k % 2 = 0 THEN lower(s_name) ELSE lower(concat('Map ', s_name, ' ', trade)) END AS name,
  CASE WHEN k % 2 = 0 THEN concat(k, ' elm st') ELSE '9 elm street' END AS address,
  CASE WHEN k % 2 = 0 THEN concat('https://maps.google.com/?q=45.', d, ',-94.', d) ELSE concat('https://maps.google.com/?q=46.', d, ',-95.', d) END AS address_url,
  CASE WHEN k % 2 = 0 THEN concat('218-555-', c) ELSE '' END AS phone, '' AS website_url, 'docks & lifts' AS services,
  CASE WHEN k % 2 = 0 THEN CAST(concat('45.', d) AS DOUBLE) ELSE CAST(concat('46.', d) AS DOUBLE) END AS lat,
  CASE WHEN k % 2 = 0 THEN CAST(concat('-94.', d) AS DOUBLE) ELSE CAST(concat('-95.', d) AS DOUBLE) END AS lon,
  'map_coordinates' AS source FROM located)"""

_COLUMNS = "page_id, name, address, address_url, phone, website_url, services"

SQL["table_businesses"] = f"WITH {_LOCATED}, {_TABLE} SELECT {_COLUMNS} FROM tables"
SQL["map_businesses"] = f"WITH {_LOCATED}, {_MAP} SELECT {_COLUMNS}, lat, lon FROM maps"
SQL["business_merge"] = f"""
WITH {_LOCATED}, {_TABLE}, {_MAP}
SELECT {_COLUMNS}, source FROM tables UNION ALL SELECT {_COLUMNS}, source FROM maps WHERE k % 2 = 1"""
SQL["business_source_counts"] = """
SELECT 'table_format' AS source, count(*) AS businesses FROM supplier
UNION ALL SELECT 'map_coordinates', count(*) FROM supplier WHERE s_suppkey % 2 = 1"""
SQL["business_csv"] = f"""
WITH {_LOCATED}, {_TABLE}, {_MAP}
SELECT name, address, address_url, phone, website_url, services, '' AS extra_locations, source FROM tables
UNION ALL
SELECT name, CASE WHEN k % 2 = 1 THEN '9 elm street' END, address_url, phone, website_url, services,
  concat(replace(address_url, 'https://maps.google.com/?q=', ''), ' (', CAST(lat AS VARCHAR), ', ', CAST(lon AS VARCHAR), ')'), source
FROM maps WHERE k % 2 = 1"""

SQL["geo_existing_match"] = f"""
WITH {_LOCATED}
SELECT page_id, 3 * i AS pos, s_name AS name, 'existing' AS outcome FROM located"""

SQL["geo_extra_locations"] = f"""
WITH {_LOCATED}
SELECT page_id, 3 * i + 1 AS pos, concat('North ', trade, ' of ', s_name, '1x') AS name,
  concat('46.', d, ', -95.', d) AS coordinates FROM located"""

SQL["geo_new_businesses"] = f"""
WITH {_LOCATED}
SELECT page_id, concat('Zq', c) AS name, concat('Coordinates: 47.', d, ', -96.', d) AS address, '' AS address_url, '' AS phone,
  '' AS website_url, '' AS services, CAST(concat('47.', d) AS DOUBLE) AS lat, CAST(concat('-96.', d) AS DOUBLE) AS lon FROM located"""

SQL["shortcode_businesses"] = f"""
WITH {_LOCATED},
points AS (SELECT page_id, k % 4 AS kind, min(k) AS k,
  string_agg(concat('North ', trade, ' of ', s_name, '1x (', CAST(CAST(concat('46.', d) AS DOUBLE) AS VARCHAR), ', ',
    CAST(CAST(concat('-95.', d) AS DOUBLE) AS VARCHAR), ')'), '; ' ORDER BY k) AS places FROM located GROUP BY ALL)
SELECT l.page_id, 1 AS part, concat(s_name, ' ', trade) AS name, 'sections' AS source, coalesce(places, '') AS extra_locations
FROM located l LEFT JOIN points p ON l.k = p.k
UNION ALL SELECT page_id, 2, concat('Zq', c), 'points', '' FROM located"""

SQL["business_route_choice"] = """
SELECT 2 * (s_suppkey // 10) AS page_id, 4 AS route, 'sections' AS source, count(*) AS businesses FROM supplier GROUP BY ALL
UNION ALL SELECT 2 * (s_suppkey // 10), 4, 'points', count(*) FROM supplier GROUP BY ALL
UNION ALL SELECT 2 * (c_custkey // 10) + 1, 1, 'markers', count(*) FROM customer WHERE c_custkey % 5 <> 4 GROUP BY ALL"""

SQL["services_labels"] = """
WITH t AS (SELECT p_partkey, lower(replace(replace(replace(replace(concat(p_name, ' ', p_type), 'bolt', 'Dock'), 'gear', 'lift'),
  'ring', 'dock lift'), 'PROMO', 'transport TRAILER')) AS t FROM part),
f AS (SELECT *, contains(t, 'dock') AS d, contains(t, 'lift') AS l, contains(t, 'trailer') AS r FROM t)
SELECT p_partkey,
  concat_ws(', ', CASE WHEN d AND l THEN 'docks & lifts' WHEN d THEN 'docks' WHEN l THEN 'lifts' END, CASE WHEN r THEN 'trailers' END) AS by_name,
  CASE WHEN NOT (d OR l OR r) THEN 'docks & lifts' ELSE concat_ws(' & ', CASE WHEN d THEN 'docks' END, CASE WHEN l THEN 'lifts' END, CASE WHEN r THEN 'trailers' END) END AS by_map,
  coalesce(CASE WHEN d AND l THEN 'docks & lifts' WHEN d THEN 'docks' WHEN l THEN 'lifts' WHEN r THEN 'trailers' END, '') AS by_cell
FROM f"""

SQL["html_blocks"] = f"""
WITH {_LOCATED}
SELECT page_id, i AS pos, s_name AS name, concat(k, ' Elm St, Elk, MN ', z) AS address, concat('218-555-', c) AS phone,
  true AS is_outermost, concat(trade, ' service') AS services, 'open daily' AS other_info FROM located"""

_LISTED = "page_id, pos, name, address, phone, services, other_info"
SQL["directory_listings"] = f"""
SELECT 1 AS part, {_LISTED} FROM ({SQL["directory_blocks"]}) UNION ALL SELECT 2, {_LISTED} FROM ({SQL["html_blocks"]})"""

# --- audit ------------------------------------------------------------------------------------

_FACTS = """page_id, site, title_length, title_words, description_length, h1_count, total_headings, has_proper_hierarchy, word_count,
  internal_links, external_links, total_images, images_with_alt, images_without_alt, flesch_score, grade_level, avg_sentence_length,
  avg_syllables_per_word, title_length_points, title_words_points, description_points, h1_points, hierarchy_points, content_points,
  image_points, reading_points, internal_link_points, external_link_points"""

SQL["seo_audit"] = f"""
WITH {_AUDIT}
SELECT {_FACTS}, seo_score, array_to_string(issue_codes, '; ') AS issues, array_to_string(advice_codes, '; ') AS recommendations FROM scored"""

SQL["seo_issue_counts"] = f"""
WITH {_AUDIT}
SELECT site, code, count(*) AS pages FROM (SELECT site, unnest(issue_codes) AS code FROM scored) GROUP BY ALL"""

SQL["seo_recommendations"] = f"""
WITH {_AUDIT},
c AS (SELECT site, code, count(*) AS pages FROM (SELECT site, unnest(advice_codes) AS code FROM scored) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pages DESC, code) AS rank FROM c)
SELECT site, code, pages, rank FROM o WHERE rank <= 5"""

SQL["site_seo_summary"] = f"""
WITH {_AUDIT}
SELECT site, count(*) AS total_pages, round(avg(seo_score), 1) AS avg_seo_score FROM scored GROUP BY site"""

SQL["site_issue_report"] = f"""
WITH {_AUDIT},
s AS (SELECT site, count(*) AS total_pages, round(avg(seo_score), 1) AS avg_seo_score FROM scored GROUP BY site),
c AS (SELECT site, code, count(*) AS pages FROM (SELECT site, unnest(issue_codes) AS code FROM scored) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pages DESC, code) AS rank FROM c)
SELECT s.site, total_pages, avg_seo_score, rank AS issue_rank, code AS issue, pages AS issue_pages
FROM s LEFT JOIN (SELECT * FROM o WHERE rank <= 5) t ON s.site = t.site"""

SQL["score_bands"] = f"""
WITH {_AUDIT}
SELECT site, CASE WHEN seo_score >= 80 THEN 'excellent' WHEN seo_score >= 60 THEN 'good' ELSE 'poor' END AS band, count(*) AS pages
FROM scored GROUP BY ALL"""

SQL["page_bands"] = f"""
WITH {_AUDIT}
SELECT page_id, site, seo_score, CASE WHEN seo_score >= 80 THEN 'excellent' WHEN seo_score >= 60 THEN 'good' ELSE 'poor' END AS score_band,
  CASE WHEN title_length BETWEEN 30 AND 60 THEN 'good' ELSE 'warning' END AS title_band, 'warning' AS description_band,
  CASE WHEN word_count >= 300 THEN 'good' WHEN word_count >= 150 THEN 'warning' ELSE 'error' END AS word_band,
  CASE WHEN flesch_score >= 60 THEN 'good' ELSE 'warning' END AS reading_band,
  CASE WHEN h1_count = 1 THEN 'good' ELSE 'error' END AS h1_band, 'good' AS image_band FROM scored"""

SQL["report_first_pages"] = f"""
WITH {_AUDIT},
o AS (SELECT site, page_id, seo_score, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rank FROM scored)
SELECT site, rank, page_id, seo_score FROM o WHERE rank <= 10"""

SQL["seo_audit_products"] = r"""
WITH t AS (SELECT *, concat(p_name, ' & ', p_brand, ' of ', p_type) AS title, concat(p_name, '''s page > ', p_brand) AS description,
    p_size % 2 AS odd FROM part),
w AS (SELECT *, regexp_extract_all(lower(concat(title, ' ', p_name, p_brand, '  co', p_type, '  Size ', p_size, 'code')), '[\p{L}\p{N}_]+') AS words FROM t),
s AS (SELECT p_partkey AS page_id, length(title) AS title_length, length(description) AS description_length, 2 AS total_images,
    1 - odd AS images_without_alt, CASE WHEN odd = 1 THEN 10 ELSE 5 END AS image_points FROM w)
SELECT page_id, title_length, description_length, total_images, images_without_alt, image_points,
  concat('Meta description length is ', description_length, ' characters (optimal: 120-160)') AS description_issue FROM s"""

# --- sites ------------------------------------------------------------------------------------

_CONTENT = f"""
{_figures('documents', 'doc_id', 'text', ', source AS site, lang AS category')},
sizes AS (SELECT site, count(*) AS total_files, count(*) FILTER (category = 'pages') AS page_files,
  coalesce(sum(word_count) FILTER (text <> ''), 0)::BIGINT AS total_words,
  coalesce(sum(character_count) FILTER (text <> ''), 0)::BIGINT AS total_characters,
  round(avg(score) FILTER (text <> ''), 2) AS avg_readability FROM figures GROUP BY site),
contacts AS ({_corpus_contacts('source AS site')}),
found AS (SELECT site, count(*) FILTER (kind = 'phone') AS phone_count, count(*) FILTER (kind = 'email') AS email_count,
  count(*) FILTER (kind = 'url') AS url_count FROM contacts GROUP BY site),
content AS (SELECT sizes.*, coalesce(phone_count, 0) AS phone_count, coalesce(email_count, 0) AS email_count, coalesce(url_count, 0) AS url_count
  FROM sizes LEFT JOIN found USING (site))"""

SQL["site_content_summary"] = f"WITH {_CONTENT} SELECT * FROM content"
SQL["site_contacts"] = f"WITH {_CONTENT} SELECT site, kind, value FROM contacts"
SQL["category_counts"] = "SELECT source AS site, lang AS category, count(*) AS files FROM documents GROUP BY ALL"

SQL["site_insights"] = f"""
WITH {_CONTENT},
n AS (
  SELECT site, CASE WHEN total_words > 10000 THEN 'large_content' WHEN total_words > 5000 THEN 'medium_content' ELSE 'compact_content' END AS code,
    format('{{:,}}', total_words) AS detail FROM content
  UNION ALL SELECT site, CASE WHEN avg_readability >= 80 THEN 'very_readable' WHEN avg_readability >= 60 THEN 'fairly_readable' ELSE 'complex' END, avg_readability::VARCHAR FROM content
  UNION ALL SELECT site, 'many_phones', phone_count::VARCHAR FROM content WHERE phone_count > 5
  UNION ALL SELECT site, 'many_emails', email_count::VARCHAR FROM content WHERE email_count > 3
  UNION ALL SELECT site, 'many_urls', url_count::VARCHAR FROM content WHERE url_count > 20
  UNION ALL SELECT site, 'many_pages', page_files::VARCHAR FROM content WHERE page_files > 10)
SELECT site, code, detail, CASE code {' '.join(f"WHEN '{code}' THEN replace('{text}', '{{0}}', detail)" for code, text in fixed.INSIGHTS.items())} END AS message FROM n"""

SQL["site_combined_metrics"] = f"""
WITH {_AUDIT},
s AS (SELECT site, count(*) AS total_pages, round(avg(seo_score), 1) AS avg_seo_score,
  coalesce(sum(len({spaced('p.text')})) FILTER (p.text <> ''), 0)::BIGINT AS total_words FROM scored JOIN p USING (page_id, site) GROUP BY site),
c AS (SELECT site, count(DISTINCT value) AS phone_count FROM (SELECT site, unnest(regexp_extract_all(text, '{fixed.CORPUS_PHONE}')) AS value FROM p) GROUP BY site)
SELECT s.site, total_words, avg_seo_score, total_pages AS total_files, coalesce(phone_count, 0) AS phone_count, total_pages
FROM s LEFT JOIN c ON s.site = c.site"""

_PHONE_LIST = "list_concat(" * 2 + f"regexp_extract_all(text, '{fixed.PAGE_PHONES[0]}')" + "".join(
    f", regexp_extract_all(text, '{p}'))" for p in fixed.PAGE_PHONES[1:]
)
_SOCIAL = ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in fixed.SOCIAL_WORDS)

SQL["page_summary"] = f"""
WITH {_METRICS},
mails AS (SELECT page_id, string_agg(value, '; ' ORDER BY i) AS email_addresses FROM (
  SELECT page_id, value, min(i) AS i FROM (
    SELECT page_id, unnest(m) AS value, unnest(range(len(m))) AS i FROM (SELECT page_id, regexp_extract_all(text, '{fixed.EMAIL}') AS m FROM metrics))
  GROUP BY page_id, value) GROUP BY page_id),
heads AS (SELECT page_id, count(*) AS business_listings FROM (
  SELECT page_id, trim(unnest(string_split(text, E'\\n')), {WS}) AS line FROM metrics) WHERE {_IS_HEADER} GROUP BY page_id)
SELECT page_id, NULL::VARCHAR AS title, url,
  coalesce(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[-1], 'home') AS slug,
  NULL::VARCHAR AS status, NULL::VARCHAR AS type, NULL::TIMESTAMP AS date_published, NULL::TIMESTAMP AS date_modified, NULL::BIGINT AS author_id,
  word_count, character_count, paragraph_count, heading_count, link_count, image_count,
  trim({TITLE}, {WS}) AS meta_title, '' AS meta_description, '' AS meta_keywords, '' AS og_title, '' AS og_description, '' AS og_image,
  '' AS canonical_url, '' AS robots, 0 AS schema_markup_count,
  array_to_string({_PHONE_LIST}, '; ') AS phone_numbers, coalesce(email_addresses, '') AS email_addresses, '' AS addresses,
  concat_ws('; ', {_SOCIAL}) AS social_links, 0 AS total_images, 0 AS total_videos, 0 AS total_audio, 0 AS form_count,
  coalesce(business_listings, 0) AS business_listings
FROM metrics LEFT JOIN mails USING (page_id) LEFT JOIN heads USING (page_id)"""

# --- sources and manifests --------------------------------------------------------------------

_ITEMS = f"""
items AS (SELECT page_id AS id, url, {SITE} AS site, {TITLE} AS title, CASE WHEN page_id % 2 = 0 THEN 'pages' ELSE 'posts' END AS rest_base,
  CASE WHEN page_id % 5 <> 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*/(?:[^?#]*/)?([^/?#]+)', 1) ELSE '' END AS slug FROM pages)"""

SQL["audited_items"] = f"""
WITH {_AUDIT}
SELECT page_id, site, title_length, word_count, seo_score FROM scored WHERE page_id % 2 = 0 AND page_id % 7 <> 0"""

SQL["item_manifest"] = f"""
WITH {_ITEMS}, n AS (SELECT id, url, site, rest_base, title, CASE WHEN slug = '' THEN id::VARCHAR ELSE slug END AS slug FROM items WHERE id % 7 <> 0)
SELECT site, rest_base AS type, id, slug, trim({sub('title', chr(92) + 's+', ' ')}, {WS}) AS title, url AS link, concat(site, '/raw_pages/', rest_base, '-', slug, '.txt') AS raw_file,
  concat(site, '/pretty_pages/', rest_base, '-', slug, '.txt') AS pretty_file FROM n"""

SQL["media_manifest"] = """
WITH m AS (SELECT p_brand AS site, p_partkey AS id, p_size::BIGINT AS post, p_name,
  CASE WHEN p_size % 11 = 1 THEN concat(p_partkey, '.bin') ELSE concat(replace(p_name, ' ', '-'), '.png') END AS name,
  CASE WHEN p_size % 11 = 1 THEN concat('https://cdn.example.com/', p_size, '/')
       ELSE concat('https://cdn.example.com/a.b/', replace(p_name, ' ', '-'), '.png?x=1') END AS source_url
  FROM part WHERE p_size % 11 <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY site, name ORDER BY id) AS nth FROM m)
SELECT site, id AS pos, id, concat(site, '/images/', CASE WHEN nth = 1 THEN name ELSE concat(replace(p_name, ' ', '-'), '-', id, '.png') END) AS file,
  source_url, post, p_name AS alt_text, '' AS title FROM o"""

SQL["content_types"] = """
WITH k AS (SELECT c_custkey AS k, (c_custkey // 10)::VARCHAR AS site FROM customer)
SELECT DISTINCT site, t.v AS rest_base FROM k, (VALUES ('pages'), ('posts')) t(v)
UNION ALL SELECT site, concat('kind-', k) FROM k WHERE k % 10 >= 5"""

SQL["slug_lookup"] = f"""
WITH {_ITEMS},
wanted AS (SELECT url, {SITE} AS site,
  coalesce(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[-1], 'home') AS slug FROM pages),
best AS (SELECT *, row_number() OVER (PARTITION BY site, slug ORDER BY rest_base, id) AS nth FROM items)
SELECT wanted.url, wanted.slug, best.id, best.rest_base
FROM wanted LEFT JOIN best ON wanted.site = best.site AND wanted.slug = best.slug AND nth = 1"""

SQL["stored_skip"] = f"WITH {_ITEMS} SELECT site, rest_base, id FROM items WHERE rest_base = 'pages'"

SQL["site_folders"] = f"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('Joes-Shop-Co-', page_id)
  ELSE regexp_replace({AUTHORITY}, '[^\\w-]', '', 'g') END AS folder FROM pages"""
