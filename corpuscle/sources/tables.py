"""Readers of the tables and of the file formats that the pipeline takes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS_SCHEMA = (
    "docweb_id bigint, url string, title string, date string, era string, tipologia array<string>, argomenti array<string>, "
    "registro_n int, fines_eur array<double>, cites array<bigint>, see_also array<bigint>, refs_in_text array<bigint>, "
    "attachments array<string>, noarchive boolean, xx_placeholders int, body_method string, body_chars int, "
    "body_sha256 string, body string"
)
CHUNKS_SCHEMA = (
    "chunk_id string, docweb_id bigint, chunk_index int, title string, date string, url string, tipologia array<string>, "
    "argomenti array<string>, section string, section_shares map<string,double>, heading string, similar_count int, "
    "weight double, text string, embed_text string, n_tokens int"
)
LISTING_CSV_SCHEMA = "titolo string, data string, tipologia string, argomenti string, estratto string, url_documento string, docweb_id string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_docs_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one JSON object a line, under their declared schema (no inference pass)."""
    return spark.read.schema(DOCS_SCHEMA).json(path)


def read_chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunks, one JSON object a line."""
    return spark.read.schema(CHUNKS_SCHEMA).json(path)


def read_listing_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Listing CSVs with header; folders and globs are allowed, files that don't exist are left out."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    there = []
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).globStatus(hp):
            there.append(p)
    if not there:
        return spark.createDataFrame([], LISTING_CSV_SCHEMA)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(LISTING_CSV_SCHEMA).csv(there)
    return raw.withColumns({c: F.filter(F.split(F.coalesce(c, F.lit("")), "; "), lambda x: x != "") for c in ("tipologia", "argomenti")})


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages, one gzip file per id: (docweb_id, html). Bytes that aren't UTF-8 become replacement characters."""

    def unpack(batches):
        import gzip

        import pyarrow as pa

        for b in batches:
            html = [gzip.decompress(x).decode("utf-8", errors="replace") for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("docweb_id"), pa.array(html, pa.string())], names=["docweb_id", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html.gz").load(path)
    ids = F.regexp_extract("path", r"(\d+)\.html\.gz$", 1).try_cast("bigint").alias("docweb_id")
    return files.select(ids, "content").mapInArrow(unpack, "docweb_id bigint, html string")


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """The near-duplicate map {representative: [{docweb_id, date, title, url}]}, flattened to one row a twin."""
    twins = "map<string, array<struct<docweb_id: bigint, date: string, title: string, url: string>>>"
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", twins)).alias("rep", "twins")).select(F.col("rep").cast("bigint").alias("docweb_id"), F.explode("twins").alias("t")).select("docweb_id", F.col("t.docweb_id").alias("similar_docweb_id"), "t.date", "t.title", "t.url")
