"""Incremental ingest of landed items; rollups stay batch jobs over the tables written here."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom import schemas
from pageloom.operators import audit, texts
from pageloom.sources import landed

#: One version of an item. Its age plays no part: an old item may land at any time. An item that does not say when it was
#: modified is told from its other versions by what it holds.
KEYS = ["site", "rest_base", "page_id", "modified", "content_hash"]


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """Item files as they land under site=.../rest_base=..."""
    return landed.files(spark.readStream, path, "site string, rest_base string")


def stored(spark: SparkSession, out: str, table: str) -> DataFrame | None:
    """What finished batches have written: items, page_text, page_audit or rejected. None before the first one."""
    try:
        done = spark.read.parquet(f"{out}/done")
        rows = spark.read.option("mergeSchema", True).parquet(f"{out}/{table}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.withColumn("tag", F.col("tag").cast("string")).join(done.select("tag"), "tag", "left_semi")


def ingest(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write new items, their page texts and audits, and the records that cannot be read, batch by batch.

    A batch lands under a tag made from its files' contents and overwrites what an interrupted run of it left; it
    counts once its tag is listed in `done`. Versions of items that other batches have stored are left out, so a new
    or lost stream checkpoint repeats nothing and loses nothing.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = batch.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("file", "value")).alias("x")).first()
        if not mark["n"]:
            return
        tag = f"b{mark['n']}x{mark['x'] & (2**64 - 1):x}"
        clean = texts.items_clean(landed.records(batch, schemas.ITEM)).withColumnRenamed("id", "page_id")
        content = F.when(F.col("modified").isNull(), F.xxhash64("title", "html", "excerpt"))
        clean = clean.withColumn("content_hash", content)
        fresh = clean.dropDuplicates(KEYS)
        before = stored(spark, out, "items")
        if before is not None:
            if "content_hash" not in before.columns:  # stored before items were told by what they hold
                before = before.withColumn("content_hash", F.lit(None).cast("long"))
            fresh = landed.not_stored(fresh, before.where(F.col("tag") != tag), KEYS)
        fresh.write.mode("overwrite").parquet(f"{out}/items/tag={tag}")
        landed.rejected(batch).write.mode("overwrite").parquet(f"{out}/rejected/tag={tag}")
        items = spark.read.schema(fresh.schema).parquet(f"{out}/items/tag={tag}")
        forms = texts.page_text(items.select("page_id", "site", "rest_base", "title", "url", "html"))
        forms.write.mode("overwrite").parquet(f"{out}/page_text/tag={tag}")
        pages = audit.page_audit(items.where(F.col("rest_base") == "pages").select("page_id", "url", "html"))
        pages.write.mode("overwrite").parquet(f"{out}/page_audit/tag={tag}")
        one = spark.range(1).select(F.lit(tag).alias("tag"), F.current_timestamp().alias("at"))
        one.write.mode("overwrite").parquet(f"{out}/done/key={tag}")

    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
