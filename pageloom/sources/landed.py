"""Readers of landed API answers and text folders."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from pageloom import schemas
from pageloom.functions import fixed
from pageloom.functions import text as X
from pageloom.functions.rows import exploded


def files(reader: DataFrameReader | DataStreamReader, path: str, partitions: str) -> DataFrame:
    """Landed files whole, with the columns their folders name: value, those columns, file."""
    landed = reader.schema(f"value string, {partitions}").option("wholetext", True).text(path)
    return landed.withColumn("file", F.col("_metadata.file_path"))


def records(landed: DataFrame, schema: str) -> DataFrame:
    """Readable records of landed JSON arrays; pos (file, place) orders them as they were landed."""
    keys = [c for c in landed.columns if c not in ("value", "file")]
    # Record by record, so that one that is no object spoils no other.
    rows = exploded(landed, F.from_json("value", "array<string>"), "file", *keys)
    read = rows.withColumn("r", _read("e", schema))
    good = read.where(F.col("r.id").isNotNull())
    return good.select("r.*", *keys, F.struct("file", F.col("pos").alias("place")).alias("pos"))


def rejected(landed: DataFrame, schema: str = schemas.ITEM) -> DataFrame:
    """What `records` of that schema cannot read: file, place in it (NULL: the whole file), its text, and the folder
    columns."""
    keys = [c for c in landed.columns if c not in ("value", "file")]
    parts = landed.withColumn("parts", F.from_json("value", "array<string>"))
    broken = parts.where(F.col("parts").isNull() & ~X.blank(F.col("value")))
    rows = exploded(parts, "parts", "file", *keys).where(_read("e", schema)["id"].isNull())
    return broken.select("file", F.lit(None).cast("int").alias("place"), F.col("value").alias("text"), *keys).unionByName(
        rows.select("file", F.col("pos").alias("place"), F.col("e").alias("text"), *keys)
    )


def _read(record: str, schema: str) -> Column:
    """A record as a struct; its id is NULL where it cannot be read."""
    return F.from_json(record, f"struct<{_typed(schema)}>")


def _typed(schema: str) -> str:
    """A column list as the fields of a struct."""
    return re.sub(r"(\w+) (?=bigint|string|timestamp|struct)", r"\1:", " ".join(schema.split()))


def item_files(spark: SparkSession, path: str) -> DataFrame:
    return files(spark.read, path, "site string, rest_base string")


def media_files(spark: SparkSession, path: str) -> DataFrame:
    return files(spark.read, path, "site string")


def items(spark: SparkSession, path: str) -> DataFrame:
    """Items landed as JSON arrays under site=.../rest_base=..., with pos; see `rejected` for the unreadable ones."""
    return records(item_files(spark, path), schemas.ITEM)


def media(spark: SparkSession, path: str) -> DataFrame:
    """Media entries landed as JSON arrays under site=..., with pos and the title as text."""
    return records(media_files(spark, path), schemas.MEDIA).withColumn("title", F.col("title.rendered"))


def content_types(
    types: DataFrame, include_all: bool = False, authenticated: bool = False
) -> DataFrame:
    """Content types to read for each site of types(site, types_json).

    Pages and posts always; with include_all also the viewable types with a plain name, less those that
    need a sign-in unless there is one.
    """
    base = types.select("site", F.explode(F.array(*[F.lit(t) for t in fixed.BASE_TYPES])).alias("rest_base"))
    if not include_all:
        return base.distinct()
    listed = types.select("site", F.explode(F.from_json("types_json", schemas.CONTENT_TYPES)).alias("key", "t"))
    name = F.col("rest_base")
    found = (
        listed.where(~F.col("key").isin("page", "post"))
        .where(F.coalesce(F.col("t.viewable"), F.lit(True)))
        .select("site", F.col("t.rest_base").alias("rest_base"))
        .where((name != "") & ~name.rlike(r"\(\?|[)\[\]+]"))
    )
    if not authenticated:
        found = found.where(~name.isin(*fixed.BLOCKED_TYPES))
    return base.union(found).distinct()


def of_types(items: DataFrame, types: DataFrame) -> DataFrame:
    """Items of the chosen types only."""
    return items.join(types, ["site", "rest_base"], "left_semi")


def find_pages(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """The item behind each URL of wanted(url): its last path part names the slug, a page beats a post.

    URLs without an item come back with a NULL id. items needs site, rest_base, id, slug and pos.
    Each slug keeps its best item before the join, so a slug shared by many items costs nothing extra.
    """
    url = F.col("url")
    asked = wanted.select("url", X.site_key(url).alias("site"), X.slug(url).alias("slug"))
    rank = F.when(F.col("rest_base") == "pages", 1).when(F.col("rest_base") == "posts", 2)
    ranked = items.withColumn("priority", rank).where(F.col("priority").isNotNull())
    order = W.partitionBy("site", "slug").orderBy("priority", "pos")
    best = ranked.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == 1)
    return asked.join(best.drop("_nth", "priority", "url"), ["site", "slug"], "left")


def text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Text files of root/<site>/pretty_pages, else raw_pages, as (site, path, category, text).

    The category is the part of the file name before its first dash. The folder of a site is chosen from
    the file names alone, so no text is read for it.
    """
    listing = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True)
    texts = listing.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    names = listing.format("binaryFile").load(root).select(F.col("_metadata.file_path").alias("path"))
    chosen = _in_folders(names).groupBy("site").agg(F.min("folder").alias("folder"))
    placed = _in_folders(texts).join(chosen, ["site", "folder"], "left_semi")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "")
    category = F.when(stem.contains("-"), F.split_part(stem, F.lit("-"), F.lit(1))).otherwise("unknown")
    return placed.select("site", "folder", "path", category.alias("category"), "text")


def _in_folders(files: DataFrame) -> DataFrame:
    """Files with the site and folder their path names, of the two text folders only."""
    parts = F.split("path", "/")
    named = files.select(F.element_at(parts, -3).alias("site"), F.element_at(parts, -2).alias("folder"), "*")
    return named.where(F.col("folder").isin("pretty_pages", "raw_pages"))


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, text)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INDEX).option("multiLine", True).json(path)


def index_items(index: DataFrame, item_type: str | None = None) -> DataFrame:
    """Entries of the site indexes, one row each."""
    rows = index.select("site", F.inline("items"))
    return rows if item_type is None else rows.where(F.col("type") == item_type)


def index_media(index: DataFrame) -> DataFrame:
    return index.select("site", F.inline("media"))


def with_texts(entries: DataFrame, texts: DataFrame, root: str = "") -> DataFrame:
    """Index entries with the text of their raw file; entries without a file are left out.

    The index may name its files relative to a root; whole paths are compared, with or without `file:` before them.
    """
    relative = ~F.col("raw_file").rlike("^([a-z0-9]+:)?/")
    base = root.rstrip("/") + "/" if root else ""
    named = F.when(relative, F.concat(F.lit(base), F.col("raw_file"))).otherwise(F.col("raw_file"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    keyed = entries.withColumn("_path", plain(named))
    return keyed.join(texts.select(plain(F.col("path")).alias("_path"), "text"), "_path").drop("_path")


def not_stored(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the stored table lacks; NULL keys equal each other."""
    have = stored.select(*[F.col(k).alias(f"_stored_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_stored_{k}")) for k in keys]
    return rows.join(have, reduce(Column.__and__, same), "left_anti")
