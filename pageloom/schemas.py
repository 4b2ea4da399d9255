"""Schemas of landed files; what a file lacks reads as NULL."""

from __future__ import annotations

RENDERED = "struct<rendered:string>"

ITEM = f"""
    id bigint, slug string, title {RENDERED}, content {RENDERED}, excerpt {RENDERED}, link string,
    status string, type string, date timestamp, modified timestamp, author bigint,
    yoast_head string, rankmath_head string
"""
MEDIA = f"id bigint, source_url string, post bigint, alt_text string, title {RENDERED}"
CONTENT_TYPES = "map<string,struct<rest_base:string,viewable:boolean>>"
INDEX = """
    site string, generated_at bigint,
    items array<struct<type:string,id:bigint,slug:string,title:string,link:string,raw_file:string,pretty_file:string>>,
    media array<struct<id:bigint,file:string,source_url:string,post:bigint,alt_text:string,title:string>>
"""
