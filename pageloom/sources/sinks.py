"""Writers of result tables, and the manifests that name what was stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as X
from pageloom.operators import texts as text_jobs

#: Folders that the sites of a stored table are dealt to.
SITE_FOLDERS = 64
CSV = {"header": True, "escape": '"', "quoteAll": True, "emptyValue": ""}


def item_manifest(items: DataFrame, root: str = "") -> DataFrame:
    """Stored files of the non-blank items: type, id, slug, title, link and the two text files."""
    kept = text_jobs.items_clean(items)
    file = F.concat("rest_base", F.lit("-"), "slug", F.lit(".txt"))
    folder = F.concat(F.lit(root), "site")
    return kept.select(
        "site",
        F.col("rest_base").alias("type"),
        "id",
        "slug",
        X.squash(F.col("title")).alias("title"),
        F.col("url").alias("link"),
        F.concat(folder, F.lit("/raw_pages/"), file).alias("raw_file"),
        F.concat(folder, F.lit("/pretty_pages/"), file).alias("pretty_file"),
    )


def media_manifest(media: DataFrame, root: str = "") -> DataFrame:
    """Media entries(site, pos, id, source_url, post, alt_text, title) with one file name each.

    The first entry keeps the name from its URL, a later one with a name already taken gets its id
    in it. Only the first position of each name is found by grouping; the join back is by position,
    which no two entries of a site share, so a name used by a third of all entries makes no hot task.
    """
    path = F.coalesce(F.try_parse_url("source_url", F.lit("PATH")), F.lit(""))
    base = F.regexp_extract(path, "([^/]*)$", 1)
    named = media.where(F.coalesce(F.col("source_url"), F.lit("")) != "").withColumn(
        "name", F.when(base != "", base).otherwise(F.concat(F.col("id").cast("string"), F.lit(".bin")))
    )
    stem = F.regexp_replace("name", r"(?<=[^.])\.[^.]*$", "")
    ext = F.regexp_extract("name", r"[^.](\.[^.]*)$", 1)
    renamed = F.concat(stem, F.lit("-"), F.col("id").cast("string"), ext)

    def firsts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("site", "name").agg(F.min("pos").alias("pos"))

    by_name = named.select("site", "name", "pos").transform(firsts)
    marked = named.join(by_name.select("site", "pos", F.lit(True).alias("keeps")), ["site", "pos"], "left")
    # A name made up for an entry is taken from then on, too.
    made = marked.where(F.col("keeps").isNull()).select("site", renamed.alias("name"), "pos")
    clash = (
        made.groupBy("site", "name")
        .agg(F.min("pos").alias("made_at"))
        .join(by_name, ["site", "name"])
        .where(F.col("made_at") < F.col("pos"))
        .select("site", "pos", F.lit(True).alias("clashes"))
    )
    file = F.when(F.col("keeps") & F.col("clashes").isNull(), F.col("name")).otherwise(renamed)
    return marked.join(clash, ["site", "pos"], "left").select(
        "site",
        "pos",
        "id",
        F.concat(F.lit(root), "site", F.lit("/images/"), file).alias("file"),
        "source_url",
        "post",
        F.coalesce("alt_text", F.lit("")).alias("alt_text"),
        F.coalesce("title", F.lit("")).alias("title"),
    )


def site_index(manifest: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of a site index, stamped with the time of writing; items in order of site, type and id."""
    stamp = F.unix_timestamp(F.current_timestamp())
    ordered = manifest.orderBy("site", "type", "id")
    return ordered.withColumn("generated_at", stamp), media.withColumn("generated_at", stamp)


def write_page_text(page_text: DataFrame, path: str, mode: str = "append") -> None:
    """All text forms in one table. A folder holds many sites, so their number stays small; a site lies together."""
    bucket = F.pmod(F.xxhash64("site"), F.lit(SITE_FOLDERS))
    rows = page_text.withColumn("site_folder", bucket).repartition("rest_base", "site_folder", F.pmod(F.hash("page_id"), F.lit(8)))
    rows = rows.sortWithinPartitions("rest_base", "site_folder", "site", "page_id")
    rows.write.mode(mode).partitionBy("rest_base", "site_folder").parquet(path)


def write_csv(table: DataFrame, path: str, by_site: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header; texts may hold line breaks, so read it back with multiLine."""
    writer = table.write.mode(mode).options(**CSV)
    (writer.partitionBy("site") if by_site else writer).csv(path)


def write_details(tables: dict[str, DataFrame], path: str) -> None:
    """Detail tables (headings, links, images, business_data) side by side."""
    for name, table in tables.items():
        write_csv(table, f"{path}/{name}")


def write_json(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    table.write.mode(mode).json(path)


def places_text(places: Column) -> Column:
    """Extra locations as 'name (lat, lon); name (lat, lon)'."""
    shown = F.transform(
        places, lambda p: F.concat(p["name"], F.lit(" ("), F.concat_ws(", ", p["lat"], p["lon"]), F.lit(")"))
    )
    return F.coalesce(F.array_join(shown, "; "), F.lit(""))


def business_csv(businesses: DataFrame, with_source: bool = True) -> DataFrame:
    """Businesses as the flat CSV rows: lists joined, NULL as empty."""
    text = ("name", "address", "address_url", "phone", "website_url")
    return businesses.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in text],
        F.coalesce(F.array_join("services", " & "), F.lit("")).alias("services"),
        places_text(F.col("extra_locations")).alias("extra_locations"),
        *(["source"] if with_source else []),
    )
