"""Word lists, limits and patterns that decide what the results are."""

from __future__ import annotations

# Stop words of the keyword audit.
STOP_WORDS = tuple(
    """
    the a an and or but in on at to for of with by from up about into through during before after
    above below between among is are was were be been have has had do does did will would could should
    may might must can this that these those i you he she it we they me him her us them
    """.split()
)

# Types read from every site, and the type names only a signed-in reader may fetch.
BASE_TYPES = ("pages", "posts")
BLOCKED_TYPES = (
    "font-families",
    "font-faces",
    "global-styles",
    "template-parts",
    "templates",
    "navigation",
    "blocks",
    "patterns",
)

# Words that mark a title as carrying the brand; callers pass their own.
BRAND_WORDS = ("dock", "lift")

SOCIAL_WORDS = ("facebook", "twitter", "instagram", "linkedin", "youtube")

# Contact patterns.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
WEB_URL = r"(?U)https?://\S+"
CORPUS_PHONE = r"\d{3}[-.]?\d{3}[-.]?\d{4}"
PAGE_PHONES = (
    r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}",
    r"\+\d{1,3}[-.\s]?\d{3,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}",
)
DASHED_PHONE = r"\d{3}-\d{3}-\d{4}"
ANY_PHONE = r"(?:\+?1[\s\-.]?)?(?:\((\d{3})\)|(\d{3}))[\s\-.]?(\d{3})[\s\-.]?(\d{4})"
LISTING_PHONE = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"

# Address patterns.
CITY_STATE_ZIP = r"([A-Z][a-zA-Z\s]+),\s*([A-Z]{2})\s*(\d{5}(?:-\d{4})?)"
STREET_CITY_STATE_ZIP = r"(\d+[^,\n]+),?\s*([A-Z][a-zA-Z\s]+),\s*([A-Z]{2})\s*(\d{5}(?:-\d{4})?)"
STREET_LINE = r"\b\d+\s+\w+\s+(st|street|ave|avenue|rd|road|blvd|boulevard|dr|drive|ln|lane|way|ct|court)"
STATE_ZIP = r"\b[A-Z]{2}\s+\d{5}(-\d{4})?\b"
MAP_STREET = (
    r"(?i)\d+.*(?:st|street|ave|avenue|rd|road|dr|drive|ln|lane|blvd|boulevard|hwy|highway)"
)
MAP_CITY = r"[A-Za-z\s]+,\s*[A-Z]{2}\s*\d{5}"

# Page elements.
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
JSON_LD = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
VIDEO_HOSTS = "(?i)youtube|vimeo|wistia"

# Page-builder shortcodes: families with the tags they open or close, raw HTML, and all others. Heading
# marks such as [H2] are ours and stay.
SHORTCODES = {
    "visual_composer": r"(?i)\[vc_\w+[^\]]*\]|\[/vc_\w+\]",
    "elementor": r"(?i)\[elementor-template[^\]]*\]|\[/elementor-template\]",
    "divi": r"(?i)\[et_pb_\w+[^\]]*\]|\[/et_pb_\w+\]",
    "nectar": r"(?i)\[nectar_\w+[^\]]*\]",
    "divider": r"(?i)\[divider[^\]]*\]|\[/divider\]",
    "ultimate": r"(?i)\[ultimate_\w+[^\]]*\]|\[/ultimate_\w+\]",
}
RAW_HTML_SHORTCODE = r"(?i)\[vc_raw_html\][^\[]*\[/vc_raw_html\]"
OTHER_SHORTCODE = r'\[(?!H[1-6]\])\w+(?:\s+\w+="[^"]*")*\s*\]|\[/\w+\]'

# What map widgets leave in a text.
MAP_SHORTCODE = r"\[nectar_gmap[^\]]*\]"
MAP_POINT_LINE = r"\d+\.\d+\s*\|\s*-?\d+\.\d+[^\n]*"
MAP_URL = r"https://\S*google\.com/maps\S*|https://maps\.app\.goo\.gl/\S*"

# Directory markup.
TABLE_ROW = r"(?s)\[vc_row_inner[^\]]*\](.*?)\[/vc_row_inner\]"
TABLE_CELL = r"(?s)\[vc_column_text\](.*?)\[/vc_column_text\]"
TEXT_SECTION = r"(?s)\[vc_column_text[^\]]*\](.*?)\[/vc_column_text\]"
MARKER_LIST = r'map_markers="([^"]+)"'
QUOTED_MARKER_LIST = r"(?s)map_markers=(?:&#8221;(.*?)&#8221;|\"(.*?)\")"
POINT = r"([\d.-]+)\s*\|\s*([\d.-]+)\s*\|\s*"
COORDINATES = r"\d+\.\d+\s*\|\s*-?\d+\.\d+"
PHONE_ONLY = r"^\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$"
WEBSITE_LINE = r"Website \| (https?://\S+)"
MAP_ANCHOR = r"""<a[^>]*href=["']([^"']*google\.com/maps[^"']*)["'][^>]*>"""
HREFS = (r'(?i)href="([^"]*)"', r"(?i)href='([^']*)'", r"(?i)href=([^\s>]+)")
MAP_QUERY = "https://maps.google.com/?q="
DETAIL_SERVICES = ("Docks & Lifts", "Trailers")

# Directory words.
SERVICE_WORDS = ("service", "repair", "parts", "sales", "marine", "boat", "engine", "motor")
LABEL_WORDS = ("website", "email", "contact", "phone", "address", "http")
NAME_TAILS = ("marine", "auto", "sales", "service", "inc", "llc", "corp")
BLOCK_CLASSES = ("dealer", "business", "listing", "directory", "card", "item")
DEFAULT_SERVICE = "docks & lifts"

# Service labels: rule set, label, words that must all occur, words that must not.
SERVICE_RULES = (
    ("name", "docks & lifts", ("dock", "lift"), ()),
    ("name", "docks", ("dock",), ("lift",)),
    ("name", "lifts", ("lift",), ("dock",)),
    ("name", "trailers", ("trailer",), ()),
    ("name", "marine", ("marine",), ()),
    ("name", "auto", ("auto",), ()),
    ("map", "docks", ("dock",), ()),
    ("map", "lifts", ("lift",), ()),
    ("map", "trailers", ("trailer",), ()),
    ("map", "trailers", ("transport",), ("trailer",)),
    ("cell", "docks & lifts", ("dock", "lift"), ()),
    ("cell", "docks", ("dock",), ("lift",)),
    ("cell", "lifts", ("lift",), ("dock",)),
    ("cell", "trailers", ("trailer",), ("dock", "lift")),
)

# Grade names by reading-ease floor.
GRADES = (
    (90, "5th grade"),
    (80, "6th grade"),
    (70, "7th grade"),
    (60, "8th-9th grade"),
    (50, "10th-12th grade"),
    (30, "College level"),
)
LOWEST_GRADE = "Graduate level"

# Line decorations of the markdown form.
PHONE_MARK = "📞 **Phone:** "
WEBSITE_MARK = "🌐 **Website:** "
EMAIL_MARK = "✉️ **Email:** "
ADDRESS_MARK = "📍 **Address:** "

# Closing block of the directory text form.
LISTING_RULE = "=" * 50
LISTING_TITLE = "🏢 STRUCTURED BUSINESS DATA (JSON):"
MAP_LINK = "[Google Maps Link]"

# Issue and recommendation texts by code; {0} takes the figure kept beside the code.
ISSUES = {
    "title_length": "Title length is {0} characters (optimal: 30-60)",
    "title_few_words": "Title is too short (less than 3 words)",
    "title_missing": "Missing page title",
    "description_length": "Meta description length is {0} characters (optimal: 120-160)",
    "description_missing": "Missing meta description",
    "h1_missing": "Missing H1 tag",
    "h1_multiple": "Multiple H1 tags found ({0})",
    "hierarchy_poor": "Poor heading hierarchy",
    "content_short": "Content too short ({0} words)",
    "alt_missing": "{0} images missing alt text",
    "hard_to_read": "Content is difficult to read",
}
RECOMMENDATIONS = {
    "title_length": "Optimize title length to 30-60 characters",
    "title_missing": "Add a descriptive page title",
    "description_length": "Optimize meta description length to 120-160 characters",
    "description_missing": "Add a compelling meta description",
    "h1_missing": "Add exactly one H1 tag per page",
    "h1_multiple": "Use only one H1 tag per page",
    "hierarchy_poor": "Structure headings properly (H1 → H2 → H3, etc.)",
    "content_medium": "Consider adding more content (current: {0} words)",
    "content_short": "Add more content (aim for 300+ words)",
    "alt_missing": "Add descriptive alt text to all images",
    "fairly_hard_to_read": "Consider simplifying content for better readability",
    "hard_to_read": "Simplify sentences and use common words",
    "few_internal_links": "Add more internal links to improve site structure",
    "many_external_links": "Consider reducing external links",
}
INSIGHTS = {
    "large_content": "📚 Large content site with {0} total words",
    "medium_content": "📄 Medium-sized content site with {0} words",
    "compact_content": "📝 Compact site with {0} words",
    "very_readable": "✅ Very readable content (score: {0})",
    "fairly_readable": "📖 Moderately readable content (score: {0})",
    "complex": "🤔 Complex content that may need simplification (score: {0})",
    "many_phones": "📞 Business-focused site with {0} phone numbers",
    "many_emails": "✉️ Multiple contact points with {0} email addresses",
    "many_urls": "🔗 Link-rich content with {0} external URLs",
    "many_pages": "🏢 Large website with {0} pages",
}
