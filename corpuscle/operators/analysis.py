"""Citation graph, document vectors, how close linked documents are, and figures of the corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import columns as C
from corpuscle.functions import italian as it
from corpuscle.session import materialise, skew_join


def citation_edges(docs: DataFrame, nodes: DataFrame, twins: DataFrame) -> DataFrame:
    """(src, dst), src < dst, distinct: links between nodes (docweb_id), a cited twin standing for its representative.

    `twins` has (docweb_id, similar_docweb_id). Unknown targets and links to oneself are dropped."""
    own = nodes.select(F.col("docweb_id").alias("target"), F.col("docweb_id").alias("node")).where("node is not null").distinct()
    via = twins.join(nodes.select("docweb_id").distinct(), "docweb_id", "left_semi").where("similar_docweb_id is not null").groupBy(F.col("similar_docweb_id").alias("target")).agg(F.min("docweb_id").alias("node"))
    place = own.unionByName(via.join(own, "target", "left_anti"))
    empty = F.array().cast("array<bigint>")
    every = F.concat(*(F.coalesce(c, empty) for c in ("cites", "see_also", "refs_in_text")))
    cited = docs.join(own.select(F.col("node").alias("docweb_id")), "docweb_id", "left_semi").select(F.col("docweb_id").alias("a"), F.explode(F.array_distinct(every)).alias("target"))
    cited = materialise(cited, "cited")
    # a decision that very many cite is joined where its citations are
    held = place.join(cited.groupBy("target").agg(F.count("*").alias("held")), "target")
    return skew_join(cited, held, ["target"], "held", cited.count()).where("a <> node").select(F.least("a", "node").alias("src"), F.greatest("a", "node").alias("dst")).distinct()


def without_procedural(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges of which neither end is one of the authority's own rules of procedure."""
    rules = docs.where(F.exists("tipologia", lambda t: F.lower(t).contains(it.PROCEDURAL_TYPE.lower()))).select("docweb_id").distinct()
    return edges.join(rules, edges.src == rules.docweb_id, "left_anti").join(rules, edges.dst == rules.docweb_id, "left_anti")


def doc_vectors(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """(docweb_id, v): sum of a document's chunk vectors, of unit length. Summed per dimension with map-side combining, so a
    document of any number of chunks is no hot spot. Vectors null, of another length or all zero are left out."""
    good = (F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0) & F.col("docweb_id").isNotNull()
    one = chunks.where(good).dropDuplicates(["chunk_id"])
    sums = one.groupBy("docweb_id").agg(*(F.sum(F.get("embedding", F.lit(i)).cast("double")).alias(f"d{i}") for i in range(dim)))
    v = sums.select("docweb_id", F.array(*(f"d{i}" for i in range(dim))).alias("s"))
    norm = F.sqrt(C.dot(F.col("s"), F.col("s")))
    return v.withColumn("n", norm).where("n > 0").select("docweb_id", F.transform("s", lambda x: x / F.col("n")).alias("v"))


def linked_cosines(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, cosine)."""
    a, b = vectors.select(F.col("docweb_id").alias("src"), F.col("v").alias("va")), vectors.select(F.col("docweb_id").alias("dst"), F.col("v").alias("vb"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", C.dot(F.col("va"), F.col("vb")).alias("cosine"))


def random_pairs(vectors: DataFrame, n: int = it.RANDOM_PAIRS) -> DataFrame:
    """(src, dst): n pairs of documents, chosen by hashing pair numbers; pairs of one document with itself are dropped."""
    w = vectors.select("docweb_id", F.xxhash64("docweb_id").alias("h"))
    count = w.count()
    # a dense number for each document, by ranges of the hash so that no single task sorts them all
    part = w.withColumn("p", F.pmod("h", F.lit(256)))
    before = part.groupBy("p").agg(F.count("*").alias("n")).withColumn("b", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = part.join(F.broadcast(before), "p").select("docweb_id", (F.row_number().over(Window.partitionBy("p").orderBy("h", "docweb_id")) - 1 + F.col("b")).alias("no"))  # before: 256 rows
    draws = vectors.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, count))).alias("i"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(max(1, count))).alias("j")).where("i <> j")
    return draws.join(numbered.select(F.col("no").alias("i"), F.col("docweb_id").alias("src")), "i").join(numbered.select(F.col("no").alias("j"), F.col("docweb_id").alias("dst")), "j").select("src", "dst")


def auc(positive: DataFrame, negative: DataFrame, column: str = "cosine") -> DataFrame:
    """(auc): probability that a positive score is above a negative one, ties counting half (Mann-Whitney). Equal scores are
    combined first, and cumulated over value ranges."""
    both = positive.select(F.col(column).alias("x"), F.lit(1).alias("p")).unionByName(negative.select(F.col(column).alias("x"), F.lit(0).alias("p")))
    ties = both.groupBy("x").agg(F.sum("p").cast("long").alias("pos"), F.sum(1 - F.col("p")).cast("long").alias("neg"))
    part = ties.withColumn("r", F.floor(F.col("x") * 512))
    below = part.groupBy("r").agg(F.sum("neg").alias("n")).withColumn("b", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("r").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scored = part.withColumn("i", inside).join(below.select("r", "b"), "r")
    return scored.agg((F.sum(F.col("pos") * (F.col("b") + F.col("i") + F.col("neg") / 2)) / F.sum("pos") / F.sum("neg")).alias("auc"))


def link_ranks(vectors: DataFrame, edges: DataFrame, block: int = 4096) -> DataFrame:
    """(src, dst, rank) in either direction: 1 + number of documents (but src) strictly closer to src than dst is.

    Only documents with links ask. They come in blocks of bounded size that the workers hold; all vectors are scanned once per
    block where they are, and only counts are shuffled."""
    ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    asked = materialise(linked_cosines(vectors, ways).select("src", "dst", F.round("cosine", 9).alias("c")).join(vectors.select(F.col("docweb_id").alias("src"), "v"), "src"), "asked")
    n = asked.count()
    blocks = max(1, -(-n // block))
    out = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("src", "dst"), F.lit(blocks)) == k).collect()
        if not rows:
            continue
        src, dst = np.array([r.src for r in rows]), np.array([r.dst for r in rows])
        q, edge = np.array([r.v for r in rows]), np.array([r.c for r in rows])

        def count(batches, src=src, dst=dst, q=q, edge=edge):
            import pyarrow as pa

            closer = np.zeros(len(src), np.int64)
            for b in batches:
                if b.num_rows:
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    s = np.round(q @ x.T, 9)
                    own = b.column(0).to_numpy()[None, :] == src[:, None]
                    closer += ((s > edge[:, None]) & ~own).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(closer)], names=["src", "dst", "n"])

        part = vectors.select("docweb_id", "v").mapInArrow(count, "src long, dst long, n long").groupBy("src", "dst").agg((F.sum("n") + 1).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "src long, dst long, rank long")


def histogram(scored: DataFrame, column: str, lo: float | None = None, hi: float | None = None, bins: int = it.HIST_BINS) -> DataFrame:
    """(bin, density) of equal bins over [lo, hi], by default the range of the scores; the greatest value falls into the last bin."""
    n, least, most = scored.agg(F.count(column), F.min(column), F.max(column)).first()
    lo, hi = least if lo is None else lo, most if hi is None else hi
    width = ((hi or 0.0) - (lo or 0.0)) / bins or 1.0
    at = F.least(F.floor((F.col(column) - F.lit(lo or 0.0)) / width), F.lit(bins - 1)).cast("int")
    return scored.groupBy(at.alias("bin")).agg((F.count("*") / F.lit(max(1, n) * width)).alias("density"))


def map_nodes(chunks: DataFrame) -> DataFrame:
    """(docweb_id, title, date, types, topics, similar_count, first_chunk): a document as the map shows it, by its first chunk; of the
    topics the first three."""
    first = F.min_by(F.struct("title", "date", "tipologia", "argomenti", "similar_count", "chunk_id"), "chunk_index").alias("x")
    one = chunks.where("docweb_id is not null and chunk_index is not null").groupBy("docweb_id").agg(first)
    return one.select("docweb_id", "x.title", "x.date", F.array_join("x.tipologia", ", ").alias("types"), F.array_join(F.slice("x.argomenti", 1, 3), ", ").alias("topics"), "x.similar_count", F.col("x.chunk_id").alias("first_chunk"))


def text_size(rows: DataFrame, name: str, column: str) -> DataFrame:
    """(name, n, mb): rows, and megabytes of a text column."""
    return rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.round(F.sum(F.octet_length(column)) / 1e6, 3).alias("mb"))


def pca_2d(vectors: DataFrame, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """(coordinates (docweb_id, x, y), one row (var_pc1, var_pc2, var_2d)): principal components of the centred vectors.

    The covariance, dim x dim whatever the collection, is summed in the workers; signs are fixed by the largest loading."""

    def moments(batches):
        import pyarrow as pa

        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                x = np.hstack([x, np.ones((len(x), 1))])
                total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "x"])

    m = np.zeros((dim + 1, dim + 1))
    for r in vectors.select("v").mapInArrow(moments, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        m[r.i, r.j] = r.x
    n = max(1.0, m[dim, dim])
    mean = m[dim, :dim] / n
    values, axes = np.linalg.eigh(m[:dim, :dim] / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    var = np.maximum(values[::-1], 0) / max(values.clip(0).sum(), 1e-300)
    centred = F.transform("v", lambda x, i: x - F.get(F.array(*map(F.lit, mean.tolist())), i))
    on = lambda k: C.dot(F.col("c"), F.array(*map(F.lit, axes[:, k].tolist())))
    xy = vectors.withColumn("c", centred).select("docweb_id", F.round(on(0), 4).alias("x"), F.round(on(1), 4).alias("y"))
    figures = vectors.sparkSession.createDataFrame([(float(var[0]), float(var[1]), float(var[0] + var[1]))], "var_pc1 double, var_pc2 double, var_2d double")
    return xy, figures


def graph_figures(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: auc, recall10, median_rank, median_linked, median_random."""
    linked, rand = linked_cosines(vectors, edges), linked_cosines(vectors, random_pairs(vectors))
    ranks = link_ranks(vectors, edges)
    return (
        auc(linked, rand)
        .join(ranks.agg(F.avg((F.col("rank") <= 10).cast("double")).alias("recall10"), F.median("rank").alias("median_rank")))
        .join(linked.agg(F.median("cosine").alias("median_linked")))
        .join(rand.agg(F.median("cosine").alias("median_random")))
    )


# ---------------------------------------------------------------------------------------------------- corpus figures


def picks(df: DataFrame, column: str, points: dict[str, float], scaled: bool) -> DataFrame:
    """One row of elements of the sorted column, not interpolated: number int(p * n) from 0 (at most the last) if `scaled`
    is False, else int(p * (n - 1)). Values are counted before they are sorted."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("x"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda p: F.floor(F.lit(p) * (F.col("n") - 1)) if scaled else F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)
    return upto.agg(*(F.min(F.when(F.col("upto") > at(p), F.col("x"))).alias(name) for name, p in points.items()))


def corpus_figures(docs: DataFrame) -> DataFrame:
    """One row of counts and sums over the documents."""
    fine = F.when(F.size("fines_eur") > 0, F.array_max("fines_eur"))
    linked = F.size(F.array_union(F.coalesce("cites", F.array().cast("array<bigint>")), F.coalesce("refs_in_text", F.array().cast("array<bigint>"))))
    chunks = F.ceil(F.col("body_chars") / 1600)
    return docs.agg(
        F.count("*").alias("documents"), F.count_if(F.col("body_chars") < it.MIN_BODY_CHARS).alias("suspect_short_bodies"),
        F.floor(F.sum("body_chars") / 4).alias("approx_tokens"), F.sum(chunks).alias("est_chunks"), F.round(F.sum(chunks) * 1024 * 2 / 1e6, 1).alias("est_vector_mb"),
        F.count_if(F.coalesce("date", F.lit("")) == "").alias("missing_date"), F.count(fine).alias("docs_with_fine"), F.median(fine).alias("fine_median"), F.max(fine).alias("fine_max"),
        F.count_if(F.size("attachments") > 0).alias("docs_with_attachments"), F.count_if("noarchive").alias("noarchive_pages"),
        F.count_if(F.col("xx_placeholders") > 0).alias("docs_with_pseudonyms"), F.sum(linked).alias("citation_edges"),
    )


def counts_by(docs: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(label, docs): occurrences of each label of an array column, most frequent first."""
    c = docs.select(F.explode(column).alias("label")).groupBy("label").agg(F.count("*").alias("docs"))
    return c if top is None else c.orderBy(F.desc("docs"), "label").limit(top)


def by_year(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.substring(F.when(F.coalesce("date", F.lit("")) == "", "????").otherwise(F.col("date")), 1, 4).alias("year")).agg(F.count("*").alias("docs"))
