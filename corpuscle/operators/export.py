"""What leaves the engine: export tables, dictionary codes, term statistics, content hashes and sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import columns as C
from corpuscle.functions import italian as it
from corpuscle.functions.stem import stem


def decisions(docs: DataFrame, chunks: DataFrame, twins: DataFrame) -> DataFrame:
    """(id, title, date, url, types, topics, similar_decisions, body) of the documents that have chunks; twins by id."""
    t = twins.where("docweb_id is not null and similar_docweb_id is not null").select("docweb_id", F.struct(F.col("similar_docweb_id").alias("id"), "date", "title", "url").alias("t")).distinct()
    similar = t.groupBy("docweb_id").agg(F.array_sort(F.collect_list("t")).alias("similar_decisions"))
    d = docs.dropDuplicates(["docweb_id"]).join(chunks.select("docweb_id").distinct(), "docweb_id", "left_semi").join(similar, "docweb_id", "left")
    none = F.array().cast(dict(similar.dtypes)["similar_decisions"])
    return d.select(F.col("docweb_id").alias("id"), "title", F.try_to_date("date", "yyyy-MM-dd").alias("date"), "url", F.col("tipologia").alias("types"), F.col("argomenti").alias("topics"), F.coalesce("similar_decisions", none).alias("similar_decisions"), "body")


def missing_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(docweb_id) with chunks but without document."""
    return chunks.select("docweb_id").where("docweb_id is not null").distinct().join(docs, "docweb_id", "left_anti")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Rows of the search table: the header without its labels, the year, and whether the decision is on a case."""
    header = F.regexp_replace(F.substring_index("embed_text", "\n\n", 1), it.HEADER_LABELS, "")
    return chunks.select(
        F.col("chunk_id").alias("id"), F.col("docweb_id").alias("decision_id"), F.col("chunk_index").alias("idx"), "section", F.coalesce("heading", F.lit("")).alias("heading"),
        "weight", F.substring("date", 1, 4).try_cast("int").alias("year"), F.col("tipologia").alias("types"), C.is_case(F.col("tipologia")).alias("is_case"), header.alias("header"), "text", "embedding",
    )


def codes(values: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 in ascending order of the distinct values. For labels, of which there are few; for keys of
    any number see dense_codes."""
    return values.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("value")) - 1)


def dense_codes(values: DataFrame, column: str, ranges: int = 64) -> DataFrame:
    """(value, code) likewise for numeric keys of any number: numbered range by range, so no task sorts them all."""
    v = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    cuts = v.agg(F.percentile_approx("value", [(i + 1) / ranges for i in range(ranges - 1)], 10_000)).first()[0] or []
    part = v.withColumn("r", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<bigint>"), lambda x: x < F.col("value"))))
    before = part.groupBy("r").agg(F.count("*").alias("n")).withColumn("b", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(F.broadcast(before.select("r", "b")), "r").select("value", (F.row_number().over(Window.partitionBy("r").orderBy("value")) - 1 + F.col("b")).alias("code"))  # before: `ranges` rows


def coded_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, decision, section, weight) with decisions and sections as codes."""
    one = chunks.dropDuplicates(["chunk_id"])
    d = dense_codes(one, "docweb_id").select(F.col("value").alias("docweb_id"), F.col("code").alias("decision_code"))
    s = codes(one, "section").select(F.col("value").alias("section"), F.col("code").alias("section_code"))
    return one.join(d, "docweb_id", "left").join(s, "section", "left").select("chunk_id", "decision_code", "section_code", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def lexeme_stats(chunks: DataFrame, stemmed: bool = True) -> DataFrame:
    """(word, ndoc): in how many chunks a stem occurs. Each word form is stemmed once: forms are counted first."""
    w = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", F.explode(F.array_distinct(C.tokens(F.concat_ws(" ", "embed_text")))).alias("form"))
    if not stemmed:
        return w.groupBy(F.col("form").alias("word")).agg(F.count("*").alias("ndoc"))
    forms = w.select("form").distinct().withColumn("word", F.pandas_udf(lambda s: s.map(stem), "string")("form"))
    return w.join(forms, "form").select("chunk_id", "word").distinct().groupBy("word").agg(F.count("*").alias("ndoc"))


def content_hash(df: DataFrame, key: str) -> str:
    """Identifies a table's content, whatever the order and partitioning of its rows: its row hashes, combined by a sum."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    n, *parts = df.agg(F.count(F.lit(1)), *(F.sum(F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(5))).first()
    import hashlib

    return hashlib.sha256(json.dumps([key, n, *(str(p) for p in parts)]).encode()).hexdigest()[:16]


def vectors_by_file(chunks: DataFrame, order: Column, dim: int = 64, item_bytes: int = 2, max_bytes: int = it.MAX_FILE_BYTES) -> DataFrame:
    """(part, ord, chunk_id, embedding): chunks in files of at most max_bytes of vectors."""
    rows = max(1, max_bytes // (dim * item_bytes))
    one = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", "embedding", F.xxhash64("chunk_id").alias("h"))
    numbered = dense_codes(one, "h").select(F.col("value").alias("h"), F.col("code").alias("ord"))
    return one.join(numbered, "h").select(F.floor(F.col("ord") / rows).alias("part"), "ord", "chunk_id", "embedding")


# ------------------------------------------------------------------------------------------------------------- sinks


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    (w.option("compression", compression) if compression else w).json(path)


def write_csv(df: DataFrame, path: str, separator: str = "; ") -> None:
    """CSV with header; array columns are joined."""
    flat = df.select(*(F.array_join(c, separator).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_record(df: DataFrame, path: str) -> None:
    """A table of one row (figures, a manifest) as one JSON object."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_families(twins: DataFrame, path: str) -> None:
    """(docweb_id, similar...) as one JSON object a representative: {"docweb_id": [twins]}."""
    t = F.struct(F.col("similar_docweb_id").alias("docweb_id"), "date", "title", "url")
    g = twins.groupBy("docweb_id").agg(F.array_sort(F.collect_list(t)).alias("t"))
    g.select(F.to_json(F.create_map(F.col("docweb_id").cast("string"), "t")).alias("value")).write.mode("overwrite").text(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Raw pages (docweb_id, html) compressed by gzip, in parts of many pages; each row keeps its id."""
    pages.select("docweb_id", "html").write.mode("overwrite").option("compression", "gzip").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of all data files below a folder. Files are hashed where they are read, part files being bounded by what
    one task writes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    root = path.rstrip("/")
    name = F.substring_index("path", f"{root}/", -1)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_search_index(chunks: DataFrame, path: str, ident: str) -> DataFrame:
    """The index that a search service loads: chunks with codes for decisions, sections and types, the values of the codes, vectors by
    file, and a manifest with a hash of each file, written last; gives the manifest."""
    spark, root = chunks.sparkSession, f"{path.rstrip('/')}/{ident}"
    one = chunks.dropDuplicates(["chunk_id"])
    coded_chunks(one).write.mode("overwrite").parquet(f"{root}/chunks")
    codes(one, "section").write.mode("overwrite").parquet(f"{root}/sections")
    codes(one.select(F.explode("tipologia").alias("type")), "type").write.mode("overwrite").parquet(f"{root}/types")
    dense_codes(one, "docweb_id").write.mode("overwrite").parquet(f"{root}/decisions")
    vectors_by_file(one, F.col("chunk_id")).write.mode("overwrite").partitionBy("part").parquet(f"{root}/vectors")
    out = manifest(spark, root)
    out.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return spark.read.schema("file string, bytes long, sha256 string").json(f"{root}/manifest")


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    """Truncate and reload a database table, keeping its definition. Structs go as JSON."""
    flat = df.select(*(F.to_json(c).alias(c) if "struct" in t else F.col(c) for c, t in df.dtypes))
    flat.write.option("truncate", True).option("batchsize", 10_000).jdbc(url, table, mode="overwrite", properties=properties or {})


def write_slices(df: DataFrame, path: str, key: str, slice_col: str) -> int:
    """Write slices that aren't there yet below path/key=<hash of the input>, each as a whole; gives the number written. An
    interrupted run is taken up again with the same key; another input has another key."""
    spark, root = df.sparkSession, f"{path.rstrip('/')}/key={key}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = {f.getPath().getName() for f in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))} if fs.exists(p) else set()
    wanted = [r[0] for r in df.select(slice_col).distinct().orderBy(slice_col).collect()]  # one value a slice
    todo = [s for s in wanted if f"slice={s}" not in done]
    for s in todo:
        df.where(F.col(slice_col) == s).drop(slice_col).write.mode("overwrite").parquet(f"{root}/slice={s}")
    return len(todo)
