"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pageloom.plans.catalog import QUERIES
from pageloom.session import local_session

HEADLINE = (
    "site_issue_report",
    "seo_audit",
    "seo_issue_counts",
    "seo_recommendations",
    "site_seo_summary",
    "readability_audit",
    "page_summary",
    "page_metrics",
    "page_headings",
    "page_links",
    "page_titles",
    "page_text_forms",
    "link_text",
    "raw_text",
    "keyword_top20",
    "bigram_top10",
    "keyword_density",
    "top_words",
    "text_stats",
    "site_content_summary",
    "site_contacts",
    "site_combined_metrics",
    "contacts_phones",
    "contacts_emails",
    "markdown_lines",
    "directory_blocks",
    "directory_sections",
    "map_markers",
    "business_merge",
    "geo_existing_match",
    "page_media",
    "page_meta_tags",
    "links_by_scope",
    "structured_data",
    "media_manifest",
    "slug_lookup",
)


TABLES = "customer documents events lineitem nation orders pages part region supplier".split()


def laid_out(spark, sf_dir: str, parts: int) -> str:
    """The tables again, each in as many files as there are cores, as tables of real size are.

    The given ones are one row group each, which only one task can read.
    """
    folder = tempfile.mkdtemp(prefix="pageloom-bench-")
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(parts).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    given, sf_dir = sf_dir, laid_out(spark, sf_dir, int(cpus))
    # One untimed query starts the JVM's compiler and the file cache.
    QUERIES["page_titles"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([\d.]+)/?$", given)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
