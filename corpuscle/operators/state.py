"""The crawl's state: upserts, work queue, and what is known already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTED = ["title", "list_date", "tipologia", "argomenti", "listing_text"]
FETCHED = ["fetch_status", "fetched_at", "raw_sha256"]
STATE_SCHEMA = (
    "docweb_id bigint, title string, list_date string, tipologia string, argomenti string, listing_text string, "
    "first_seen timestamp, fetch_status int, fetched_at timestamp, raw_sha256 string"
)
PAGES_SCHEMA = "order_dir string, page int, n_items int, fetched_at timestamp"


def create_tables(spark: SparkSession, docs: str = "crawl_docs", pages: str = "listing_pages") -> None:
    """The two state tables, if they aren't there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {docs} ({STATE_SCHEMA}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {pages} ({PAGES_SCHEMA}) USING parquet")


def upsert_listing(state: DataFrame, items: DataFrame, now) -> DataFrame:
    """The state after listing items (docweb_id and the listed columns) came in: listed columns are replaced, first_seen and
    the fetch columns kept; new ids are first seen `now`. Of items that repeat an id the last by `item_no`, if there is such a
    column, else the greatest row counts. Items without id are left out."""
    order = F.col("item_no") if "item_no" in items.columns else F.struct(*LISTED)
    new = items.where("docweb_id is not null").groupBy("docweb_id").agg(F.max_by(F.struct(*LISTED), order).alias("new"))
    j = state.join(new, "docweb_id", "full")
    took = F.col("new").isNotNull()
    cols = [F.when(took, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in LISTED]
    return j.select("docweb_id", *cols, F.coalesce("first_seen", F.when(took, F.lit(now))).alias("first_seen"), *FETCHED)


def record_fetches(state: DataFrame, fetched: DataFrame) -> DataFrame:
    """The state after fetches (docweb_id, fetch_status, fetched_at, raw_sha256), the latest per id counting."""
    new = fetched.where("docweb_id is not null").groupBy("docweb_id").agg(F.max_by(F.struct(*FETCHED), "fetched_at").alias("new"))
    j = state.join(new, "docweb_id", "left")
    return j.select("docweb_id", *LISTED, "first_seen", *(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in FETCHED))


def replace_by_key(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with the rows of the same keys replaced by `rows`."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def current_state(log: DataFrame) -> DataFrame:
    """The crawl table that a log of its writes adds up to: per id the last row by written_at and log_id, with the earliest
    first_seen."""
    return log.where("docweb_id is not null").groupBy("docweb_id").agg(
        *(F.max_by(c, F.struct("written_at", "log_id")).alias(c) for c in LISTED), F.min("first_seen").alias("first_seen"), *(F.max_by(c, F.struct("written_at", "log_id")).alias(c) for c in FETCHED)
    )


def work_queue(state: DataFrame, limit: int | None = None, random: bool = False, seed: int = 0) -> DataFrame:
    """(docweb_id) still to be fetched: neither fetched, gone nor refused; by id, or in random order."""
    open_ = state.where("fetch_status is null or fetch_status not in (200, 404, -1)").select("docweb_id")
    if limit is None:
        return open_
    return open_.orderBy(F.xxhash64("docweb_id", F.lit(seed)) if random else F.col("docweb_id")).limit(limit)


def unknown_ids(scraped: DataFrame, *known: DataFrame, key: str = "docweb_id") -> DataFrame:
    """Rows of ids in none of the `known` tables, one per id."""
    seen = None
    for k in known:
        seen = k.select(key) if seen is None else seen.union(k.select(key))
    fresh = scraped.where(F.col(key).isNotNull())
    return (fresh if seen is None else fresh.join(seen.distinct(), key, "left_anti")).dropDuplicates([key])


def next_page(pages: DataFrame, order_dir: str) -> int:
    """The page with which an interrupted backfill goes on."""
    return int(pages.where(F.col("order_dir") == order_dir).agg(F.coalesce(F.max("page"), F.lit(0)) + 1).first()[0])


def until_known(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(page, new): the pages of a listing (page, docweb_id), newest first, up to the first without an id that isn't `known`: there an
    incremental sync stops."""
    ids = listing.where("docweb_id is not null").select("page", "docweb_id")
    seen = known.select("docweb_id").where("docweb_id is not null").distinct().withColumn("seen", F.lit(True))
    pages = ids.join(seen, "docweb_id", "left").groupBy("page").agg(F.count_if(F.col("seen").isNull()).alias("new"))
    stop = pages.where("new = 0").agg(F.min("page").alias("stop"))  # one row
    return pages.join(F.broadcast(stop)).where("stop is null or page <= stop").select("page", "new")


def edited(state: DataFrame, parsed: DataFrame) -> DataFrame:
    """(docweb_id) whose body changed, by the hash of the text and not of the page."""
    p = parsed.select("docweb_id", F.col("body_sha256").alias("now")).dropDuplicates(["docweb_id"])
    return state.select("docweb_id", "body_sha256").dropDuplicates(["docweb_id"]).join(p, "docweb_id").where("not (now <=> body_sha256)").select("docweb_id")


def newest_rows(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
