"""BM25 postings, dense scores, their fusion by reciprocal ranks, results grouped by document, and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import columns as C
from corpuscle.functions import italian as it
from corpuscle.operators.export import content_hash
from corpuscle.operators.topdocs import top_documents
from corpuscle.session import materialise, skew_join, small

#: Queries scored in one pass over the chunks; their vectors are what every worker holds.
BLOCK_QUERIES = 2_000


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id; repeats of a chunk are equal."""
    return chunks.where("chunk_id is not null").dropDuplicates(["chunk_id"])


def term_frequencies(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "embed_text", stemmed: bool = False) -> DataFrame:
    """(id, term, tf, len): counts of search terms, len being all terms of the chunk. With stemmed=True, terms are stems."""
    if stemmed:
        return chunks.select(id_col, text_col).mapInArrow(_stemmed_counts, f"{id_col} {dict(chunks.dtypes)[id_col]}, term string, tf bigint, len bigint")
    words = chunks.select(id_col, C.tokens(F.col(text_col)).alias("w")).withColumn("len", F.size("w").cast("bigint"))
    return words.select(id_col, "len", F.explode("w").alias("term")).groupBy(id_col, "term", "len").agg(F.count("*").alias("tf")).select(id_col, "term", "tf", "len")


def _stemmed_counts(batches):
    """Stems are remembered, so each word form is stemmed once per partition."""
    import re
    from collections import Counter

    import pyarrow as pa

    from corpuscle.functions.stem import stem

    stop, word, known = frozenset(it.STOPWORDS), re.compile(it.WORD), {}
    for b in batches:
        ids, terms, tfs, lens = [], [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n: Counter = Counter()
            for w in word.findall((text or "").lower()):
                if len(w) > 1 and w not in stop:
                    if w not in known:
                        known[w] = stem(w)
                    n[known[w]] += 1
            ids += [i] * len(n)
            terms += n.keys()
            tfs += n.values()
            lens += [n.total()] * len(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(lens, pa.int64())], names=[b.schema.field(0).name, "term", "tf", "len"])


def bm25_postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "embed_text", stemmed: bool = False) -> DataFrame:
    """(id, term, weight): the index. A query's score of a chunk is the sum of the weights of its distinct terms."""
    tf = materialise(term_frequencies(chunks, id_col, text_col, stemmed), "tf")
    n = chunks.select(id_col).count()
    total = tf.agg(F.coalesce(F.sum("tf"), F.lit(0)), F.count("*")).first()
    mean = (total[0] or 1) / max(1, n)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = it.BM25_K1 * (1 - it.BM25_B + it.BM25_B * F.col("len") / F.lit(float(mean)))
    return skew_join(tf, df, ["term"], "df", total[1]).select(id_col, "term", (F.col("tf") * (it.BM25_K1 + 1) / (F.col("tf") + norm) * idf).alias("weight"))


def write_index(chunks: DataFrame, path: str, stemmed: bool = True) -> str:
    """Store the postings of the chunks at `path`, sorted by term (a query reads few row groups), with a hash of what they were made of;
    gives the hash. An index of the same chunks is left as it is."""
    one = distinct_chunks(chunks)
    key = content_hash(one.select("chunk_id", "embed_text"), f"bm25 {'stems' if stemmed else 'forms'}")
    if stored_key(chunks.sparkSession, path) != key:
        bm25_postings(one, stemmed=stemmed).repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        chunks.sparkSession.createDataFrame([(key, stemmed)], "key string, stemmed boolean").coalesce(1).write.mode("overwrite").json(f"{path}/key")
    return key


def stored_key(spark: SparkSession, path: str) -> str | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/key")
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    return spark.read.schema("key string, stemmed boolean").json(f"{path}/key").first().key if there else None


def read_index(chunks: DataFrame, path: str, stemmed: bool = True) -> DataFrame:
    """The stored postings (chunk_id, term, weight); an error if there are none, or if they are of other chunks."""
    now = content_hash(distinct_chunks(chunks).select("chunk_id", "embed_text"), f"bm25 {'stems' if stemmed else 'forms'}")
    if stored_key(chunks.sparkSession, path) != now:
        raise ValueError(f"no keyword index of these chunks at {path}: write_index() makes one")
    return chunks.sparkSession.read.parquet(f"{path}/postings")


def embed(chunks: DataFrame, encode: Callable[[list[str]], np.ndarray], model: str, path: str | None = None, text_col: str = "embed_text") -> DataFrame:
    """(chunk_id, model, embedding): unit vectors of the chunks' texts by `encode`, which maps a batch of texts to an array and is
    shipped to the workers. With a path, they are written below it, one folder a model, and read back."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            v = np.asarray(encode(texts), dtype=np.float32).reshape(len(texts), -1)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

    got = distinct_chunks(chunks).select("chunk_id", text_col).mapInArrow(run, "chunk_id string, embedding array<float>").withColumn("model", F.lit(model))
    if path is None:
        return got.select("chunk_id", "model", "embedding")
    got.drop("model").write.mode("overwrite").parquet(f"{path}/model={model}")
    return read_vectors(chunks.sparkSession, path, model)


def read_vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(chunk_id, model, embedding) of one model; other models' folders are not read."""
    return spark.read.parquet(path).where(F.col("model") == model).select("chunk_id", "model", "embedding")


def query_terms(queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """(query_id, term), distinct."""
    if stemmed:
        return query_stems(queries)
    return queries.select("query_id", F.explode(F.array_distinct(C.tokens(F.col("query")))).alias("term"))


def query_stems(queries: DataFrame) -> DataFrame:
    return term_frequencies(queries, "query_id", "query", stemmed=True).select("query_id", "term")


def bm25_scores(postings: DataFrame, queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """(query_id, chunk_id, lexical) of chunks with at least one query term."""
    return postings.join(query_terms(queries, stemmed), "term").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("lexical"))


def query_blocks(queries: DataFrame, block: int = BLOCK_QUERIES) -> Iterable[tuple[list, np.ndarray]]:
    """Ids and unit vectors of the queries, in blocks of bounded size; null and all-zero vectors are left out."""
    n = queries.count()
    blocks = max(1, -(-n // block))
    for k in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else queries
        rows = [(r.query_id, np.asarray(r.embedding, dtype=np.float64)) for r in part.select("query_id", "embedding").where("embedding is not null").dropDuplicates(["query_id"]).collect()]
        rows = [(i, v / np.linalg.norm(v)) for i, v in rows if np.linalg.norm(v) > 0]
        if rows:
            yield [i for i, _ in rows], np.stack([v for _, v in rows])


def dense_scores(chunks: DataFrame, queries: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, chunk_id, dense): cosine of every chunk with every query, or of each query's `top` chunks per batch.

    Queries come in blocks that the workers hold; chunks are never shuffled. Chunks whose vector is null, zero or of another
    length have no score."""
    spark, qt = chunks.sparkSession, dict(queries.dtypes)["query_id"]
    schema = f"query_id {qt}, chunk_id string, dense double"
    out = None
    for ids, q in query_blocks(queries):

        def score(batches, ids=ids, q=q):
            import pyarrow as pa

            for b in batches:
                ok = [i for i, v in enumerate(b.column(1).to_pylist()) if v is not None and len(v) == q.shape[1] and any(v)]
                if not ok:
                    continue
                x = b.column(1).take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(len(ok), -1).astype(np.float64)
                s = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                if top is not None and s.shape[1] > top:
                    edge = np.partition(s, s.shape[1] - top, axis=1)[:, -top][:, None]
                    qi, ci = np.nonzero(s >= edge)
                else:
                    qi, ci = (a.ravel() for a in np.indices(s.shape))
                names = b.column(0).take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([pa.array(ids, _arrow(qt)).take(pa.array(qi)), names.take(pa.array(ci)), pa.array(s[qi, ci])], names=["query_id", "chunk_id", "dense"])

        part = chunks.select("chunk_id", "embedding").mapInArrow(score, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _arrow(t: str):
    import pyarrow as pa

    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]


def cosine_topk(chunks: DataFrame, queries: DataFrame, k: int = it.EVAL_K) -> DataFrame:
    """(query_id, chunk_id, score, rank): each query's k closest chunks. Batches send on their own best k (and ties) only."""
    s = dense_scores(distinct_chunks(chunks), queries, top=k).withColumn("score", F.round("dense", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = it.EVAL_K, stemmed: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank): each query's k best chunks by keywords."""
    s = bm25_scores(bm25_postings(distinct_chunks(chunks), stemmed=stemmed), queries, stemmed).withColumn("score", F.round("lexical", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def hybrid_scores(chunks: DataFrame, queries: DataFrame, alpha: float = it.HYBRID_ALPHA, weighted: bool = True, stemmed: bool = True, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that can be ranked: the closer of meaning and of wording.

    alpha 0: cosine; alpha 1: BM25 (0 without query terms); between: reciprocal ranks over all chunks, from 0, of both
    scores, the keyword part only where there is a query term. Scores are times the section weight (null: 1). Ties go by
    chunk_id. Ranks are within a query; scores are rounded to nine places before ranking."""
    one = distinct_chunks(chunks)
    weight = one.select("chunk_id", (F.coalesce("weight", F.lit(1.0)) if weighted else F.lit(1.0)).alias("w"))
    dense = dense_scores(one, queries).join(weight, "chunk_id").select("query_id", "chunk_id", F.round(F.col("dense") * F.col("w"), 9).alias("dense"))
    if alpha <= 0:
        return dense.withColumnRenamed("dense", "score")
    index = bm25_postings(one, stemmed=stemmed) if postings is None else postings
    lexical = bm25_scores(index, queries, stemmed).join(weight, "chunk_id").select("query_id", "chunk_id", F.round(F.col("lexical") * F.col("w"), 9).alias("lexical"))
    if alpha >= 1:
        both = dense.join(lexical, ["query_id", "chunk_id"], "left")
        return both.select("query_id", "chunk_id", F.coalesce("lexical", F.lit(0.0)).alias("score"))
    share = queries.select("query_id", C.effective_alpha(F.col("query"), alpha).alias("a")).dropDuplicates(["query_id"])
    rd = score_ranks(dense, "dense", 256).withColumnRenamed("rank", "rd")
    # only chunks with a query term have a keyword part, so only these are ranked by it; chunks without vector are in no ranking
    own = lexical.where("lexical > 0").join(dense.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    rl = score_ranks(own, "lexical", 16).select("query_id", "chunk_id", F.col("rank").alias("rl"))
    ranked = rd.join(rl, ["query_id", "chunk_id"], "left").join(small(share), "query_id")
    fused = (1 - F.col("a")) / (it.RRF_K + F.col("rd")) + F.coalesce(F.col("a") / (it.RRF_K + F.col("rl")), F.lit(0.0))
    return ranked.select("query_id", "chunk_id", F.round(fused, 12).alias("score"))


def score_ranks(scores: DataFrame, column: str, per_unit: int) -> DataFrame:
    """`scores` (query_id, chunk_id, a score) with `rank` from 0 within the query, by score descending, then chunk_id.

    A query's rows are cut into ranges of the score, `per_unit` in each unit of it; a range is ranked by its own task, and the rows in
    higher ranges are added, so no task sorts all chunks of a query. The counts are partitioned like the rows they are joined to."""
    cut = scores.withColumn("part", F.floor(F.col(column) * per_unit))
    above = Window.partitionBy("query_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("query_id", "part").agg(F.count("*").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc(column), "chunk_id")) - 1
    return cut.join(counts, ["query_id", "part"]).withColumn("rank", inside + F.col("above")).drop("part", "above")


def search(chunks: DataFrame, queries: DataFrame, k: int = it.EVAL_K, alpha: float = it.HYBRID_ALPHA, weighted: bool = True, scope: str | None = None, years: tuple[int, int] | None = None, types: list[str] | None = None, stemmed: bool = True, postings: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query, with their best chunk and their best passages on activity and violation.

    (query_id, rank, docweb_id, score, chunk_id, activity_score, activity_chunk, violation_score, violation_chunk). Scope, years
    (inclusive, no date counting as year 0) and types are applied after ranking, so they never change a chunk's score. `postings` are
    those of read_index(), else they are made. Words are Italian stems unless stemmed=False."""
    keep = C.in_scope(scope, F.col("section"), F.col("tipologia"))
    if years is not None:
        keep = keep & C.year(F.col("date")).between(*years)
    if types:
        keep = keep & F.coalesce(F.arrays_overlap("tipologia", F.array(*map(F.lit, types))), F.lit(False))
    one, role = distinct_chunks(chunks), C.roles(F.coalesce("section", F.lit("testo")))
    weight = F.coalesce("weight", F.lit(1.0)) if weighted else F.lit(1.0)
    code = F.when(role == "activity", 1).when(role == "violation", 2).otherwise(0)
    rows = one.select("chunk_id", "docweb_id", weight.cast("double").alias("w"), F.coalesce(keep, F.lit(False)).alias("keep"), code.alias("role"), "embedding")
    asked = queries.where("embedding is not null").dropDuplicates(["query_id"]).select("query_id", "embedding", "query", C.effective_alpha(F.col("query"), alpha).alias("a"))
    asked = materialise(asked, "asked")
    if alpha <= 0:
        return top_documents(rows, asked.withColumn("terms", F.array().cast("array<string>")), None, k, alpha)
    terms = query_terms(asked, stemmed)
    index = (bm25_postings(one, stemmed=stemmed) if postings is None else postings).join(small(terms.select("term").distinct()), "term")
    asked = asked.join(terms.groupBy("query_id").agg(F.collect_set("term").alias("terms")), "query_id", "left")
    return top_documents(rows, asked, index, k, alpha)


def evaluate(results: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = it.EVAL_K) -> DataFrame:
    """(query_id, lang, precision, rr): a result is relevant if its best chunk has one of the query's tags. Precision is over
    k, whatever was returned; rr is 0 without a relevant result. Results are joined by shuffle: Spark takes them for about as
    large as the queries, of which each has k, so it would broadcast them."""
    tags = queries.select("query_id", "lang", "tags").dropDuplicates(["query_id"])
    topics = distinct_chunks(chunks).select("chunk_id", "argomenti")
    rel = results.hint("merge").join(topics, "chunk_id").join(tags.select("query_id", "tags"), "query_id").withColumn("rel", F.coalesce(F.arrays_overlap("tags", "argomenti"), F.lit(False)))
    per = rel.groupBy("query_id").agg(F.count_if("rel").alias("n"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"))
    return tags.join(per, "query_id", "left").select("query_id", "lang", (F.coalesce("n", F.lit(0)) / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def evaluation_summary(per_query: DataFrame) -> DataFrame:
    """(lang, queries, precision, mrr), and a row 'all'."""
    r = per_query.rollup("lang").agg(F.grouping("lang").alias("whole"), F.count("*").alias("queries"), F.avg("precision").alias("precision"), F.avg("rr").alias("mrr"))
    return r.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("lang")).alias("lang"), "queries", "precision", "mrr")
