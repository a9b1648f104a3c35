"""The registered queries of the core, and SQL for those that SQL can express.

Every query runs over its whole tables. Scores are rounded alike on both sides before they are ranked, so that the order
of summation decides no tie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import columns as C
from corpuscle.functions import italian as it
from corpuscle.operators import analysis, documents, export, search, state
from corpuscle.operators.incremental import replay
from corpuscle.session import materialise, shared_dir
from corpuscle.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH ok AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS seq FROM crawl_runs WHERE status = 'ok'),
      v AS (SELECT ok.seq, ok.run_id, s.docweb_id, arg_max(s.fetch_status, s.fetched_at) AS st, arg_max(coalesce(s.raw_sha256, ''), s.fetched_at) AS sha FROM docs_state s JOIN ok ON s.written_at < ok.started_at WHERE s.fetched_at IS NOT NULL AND s.docweb_id IS NOT NULL GROUP BY ALL),
      g AS (SELECT *, lag(sha) OVER (PARTITION BY docweb_id ORDER BY seq) AS old FROM v WHERE st = 200)
      SELECT run_id, docweb_id FROM g WHERE old IS DISTINCT FROM sha AND sha <> ''"""
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return replay(table(spark, d, "docs_state"), table(spark, d, "crawl_runs")).select("run_id", "docweb_id")


# ------------------------------------------------------------------------------------------------- search

_STOP = ", ".join(f"'{w}'" for w in it.STOPWORDS)
_TOK = lambda c: f"list_filter(regexp_extract_all(lower({c}), '{it.WORD}'), lambda x: length(x) > 1 AND NOT list_contains([{_STOP}], x))"
_TF = f"""one AS (SELECT chunk_id, any_value(embed_text) AS t, any_value(embedding) AS v, any_value(coalesce(weight, 1.0)) AS w, any_value(docweb_id) AS docweb_id, any_value(section) AS section, any_value(tipologia) AS tipologia, any_value(argomenti) AS argomenti, any_value(date) AS date FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
  words AS (SELECT chunk_id, unnest({_TOK("t")}) AS term FROM one),
  tf AS (SELECT chunk_id, term, count(*) AS tf FROM words GROUP BY ALL),
  ln AS (SELECT chunk_id, sum(tf)::BIGINT AS len FROM tf GROUP BY chunk_id),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  n AS (SELECT (SELECT count(*) FROM one) AS n, (SELECT sum(len) FROM ln) / (SELECT count(*) FROM one) AS mean),
  post AS (SELECT chunk_id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) * ln(1 + (n - df + 0.5) / (df + 0.5)) AS weight FROM tf JOIN df USING (term) JOIN ln USING (chunk_id), n)"""
_SCORES = f"""{_TF},
  qt AS (SELECT DISTINCT query_id, unnest({_TOK("query")}) AS term FROM queries),
  lex AS (SELECT query_id, chunk_id, sum(weight) AS s FROM post JOIN qt USING (term) GROUP BY ALL),
  u AS (SELECT chunk_id, v::DOUBLE[] AS v, sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[])) AS l FROM one WHERE len(v) = 64),
  q AS (SELECT query_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM queries WHERE embedding IS NOT NULL),
  den AS (SELECT q.query_id, u.chunk_id, list_inner_product(u.v, q.v) / u.l / q.l AS s FROM u, q WHERE u.l > 0 AND q.l > 0)"""
_BOTH = """b AS (SELECT den.query_id, den.chunk_id, round(den.s * one.w, 9) AS dense, coalesce(round(lex.s * one.w, 9), 0) AS lexical FROM den JOIN one USING (chunk_id) LEFT JOIN lex USING (query_id, chunk_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) - 1 AS rd, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) - 1 AS rl FROM b),
  a AS (SELECT query_id, CASE WHEN regexp_matches(query, '[0-9]|["“”«»]') THEN 0.6 ELSE 0.3 END AS a FROM queries),
  s AS (SELECT query_id, chunk_id, round((1 - a) / (60 + rd) + CASE WHEN lexical > 0 THEN a / (60 + rl) ELSE 0 END, 12) AS score FROM r JOIN a USING (query_id))"""
_ROLE = "CASE WHEN section IN ('sintesi', 'fatti') THEN 'activity' WHEN section IN ('motivazione', 'dispositivo') THEN 'violation' END"


def _top_docs(mask: str = "TRUE") -> str:
    return f"""m AS (SELECT s.*, docweb_id, {_ROLE} AS role FROM s JOIN one USING (chunk_id) WHERE {mask}),
  g AS (SELECT query_id, docweb_id, min((-score, chunk_id)) AS t, min((-score, chunk_id)) FILTER (role = 'activity') AS act, min((-score, chunk_id)) FILTER (role = 'violation') AS vio FROM m GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t) AS rank FROM g),
  res AS (SELECT query_id, rank, docweb_id, -t[1] AS score, t[2] AS chunk_id, -act[1] AS activity_score, act[2] AS activity_chunk, -vio[1] AS violation_score, vio[2] AS violation_chunk FROM k WHERE rank <= 10)"""


@query(f"WITH {_SCORES}, {_BOTH}, {_top_docs()} SELECT * FROM res")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(table(spark, d, "chunks"), table(spark, d, "queries"), stemmed=False)


_CASES = ", ".join(f"'{c}'" for c in it.CASE_TYPES)
_MASK = f"{_ROLE} = 'violation' AND list_has_any(tipologia, [{_CASES}]) AND coalesce(try_cast(substr(date, 1, 4) AS INTEGER), 0) BETWEEN 2010 AND 2024 AND list_has_any(tipologia, ['Decisione su ricorso', 'Ordinanza ingiunzione o revoca'])"


@query(f"WITH {_SCORES}, {_BOTH}, {_top_docs(_MASK)} SELECT * FROM res")
def search_masked(spark: SparkSession, d: str) -> DataFrame:
    """Scope, years and types are applied after ranking."""
    return search.search(table(spark, d, "chunks"), table(spark, d, "queries"), scope="violation", years=(2010, 2024), types=["Decisione su ricorso", "Ordinanza ingiunzione o revoca"], stemmed=False)


@query(f"WITH {_SCORES}, s AS (SELECT query_id, chunk_id, round(den.s * w, 9) AS score FROM den JOIN one USING (chunk_id)), {_top_docs()} SELECT * FROM res")
def search_dense_only(spark: SparkSession, d: str) -> DataFrame:
    return search.search(table(spark, d, "chunks"), table(spark, d, "queries"), alpha=0.0)


@query(f"WITH {_SCORES}, s AS (SELECT den.query_id, chunk_id, coalesce(round(lex.s * w, 9), 0) AS score FROM den JOIN one USING (chunk_id) LEFT JOIN lex USING (query_id, chunk_id)), {_top_docs()} SELECT * FROM res")
def search_keywords_only(spark: SparkSession, d: str) -> DataFrame:
    return search.search(table(spark, d, "chunks"), table(spark, d, "queries"), alpha=1.0, stemmed=False)


@query()
def search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """As hybrid_search, with Italian stems, which is the default, on a stored index; no SQL, as there is no stemmer in it."""
    chunks, path = table(spark, d, "chunks"), f"{shared_dir(spark)}/indexes/{d.strip('/').replace('/', '_')}"
    search.write_index(chunks, path)
    return search.search(chunks, table(spark, d, "queries"), postings=search.read_index(chunks, path))


@query(f"WITH {_TF} SELECT chunk_id, term, tf, len FROM tf JOIN ln USING (chunk_id)")
def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return search.term_frequencies(search.distinct_chunks(table(spark, d, "chunks")))


@query(f"WITH {_TF} SELECT term, df FROM df")
def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return search.term_frequencies(search.distinct_chunks(table(spark, d, "chunks"))).groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_TF} SELECT chunk_id, term, round(weight, 6) AS weight FROM post")
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_postings(search.distinct_chunks(table(spark, d, "chunks"))).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_SCORES}, r AS (SELECT query_id, chunk_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM lex) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_topk(table(spark, d, "chunks"), table(spark, d, "queries")).withColumn("score", F.round("score", 6))


@query(f"WITH {_SCORES}, r AS (SELECT query_id, chunk_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM den) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.cosine_topk(table(spark, d, "chunks"), table(spark, d, "queries")).withColumn("score", F.round("score", 6))


@query("SELECT query_id, CASE WHEN regexp_matches(query, '[0-9]|[\"“”«»]') THEN 0.6 ELSE 0.3 END::DOUBLE AS alpha FROM queries")
def effective_alpha(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", C.effective_alpha(F.col("query"), it.HYBRID_ALPHA).alias("alpha"))


_EVAL = f"""WITH {_SCORES}, {_BOTH}, {_top_docs()},
  rel AS (SELECT res.query_id, rank, coalesce(list_has_any(tags, argomenti), false) AS rel FROM res JOIN one USING (chunk_id) JOIN queries USING (query_id)),
  ev AS (SELECT query_id, lang, count(*) FILTER (rel) / 10 AS precision, coalesce(1 / min(rank) FILTER (rel), 0) AS rr FROM queries LEFT JOIN rel USING (query_id) GROUP BY ALL)"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    c, q = table(spark, d, "chunks"), table(spark, d, "queries")
    return search.evaluate(search.search(c, q, stemmed=False), c, q)


@query(f"{_EVAL} SELECT query_id, lang, precision, round(rr, 6) AS rr FROM ev")
def retrieval_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).withColumn("rr", F.round("rr", 6))


@query(f"{_EVAL} SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(rr), 6) AS mrr FROM ev GROUP BY ROLLUP (lang)")
def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    return search.evaluation_summary(_evaluated(spark, d)).withColumns({c: F.round(c, 6) for c in ("precision", "mrr")})


# ----------------------------------------------------------------------------------------------- documents

_REASON = "CASE WHEN coalesce(body_chars, 0) < 300 THEN 'short_or_empty' WHEN regexp_matches(coalesce(body, ''), '(?m)Attendere prego|^Redirect$') THEN 'redirect_stub' END"


@query(
    f"""WITH r AS (SELECT *, {_REASON} AS reason FROM docs), w AS (SELECT *, row_number() OVER (PARTITION BY reason, coalesce(body_sha256, 'id' || docweb_id) ORDER BY date DESC NULLS LAST, docweb_id DESC) AS n FROM r)
      SELECT docweb_id, coalesce(reason, CASE WHEN n = 1 THEN 'keep' ELSE 'duplicate_body' END) AS verdict FROM w"""
)
def selection_without_language(spark: SparkSession, d: str) -> DataFrame:
    return documents.select_documents(table(spark, d, "docs"), language=False).select("docweb_id", "verdict")


@query()
def select_documents(spark: SparkSession, d: str) -> DataFrame:
    """With the test for English documents, which needs joined paragraphs."""
    return documents.select_documents(table(spark, d, "docs")).select("docweb_id", "verdict")


@query()
def reject_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents.select_documents(table(spark, d, "docs")).groupBy("verdict").agg(F.count("*").alias("docs"))


@query(
    f"""WITH r AS (SELECT *, {_REASON} AS reason FROM docs), w AS (SELECT *, row_number() OVER (PARTITION BY reason, coalesce(body_sha256, 'id' || docweb_id) ORDER BY date DESC NULLS LAST, docweb_id DESC) AS n FROM r),
      v AS (SELECT docweb_id, coalesce(date, '') AS day, coalesce(reason, CASE WHEN n = 1 THEN 'keep' ELSE 'duplicate_body' END) AS verdict FROM w),
      e AS (SELECT day, docweb_id FROM v WHERE verdict = 'keep' ORDER BY day DESC, docweb_id DESC LIMIT 200), edge AS (SELECT min((day, docweb_id)) AS x FROM e)
      SELECT verdict, count(*) AS docs FROM v, edge WHERE (day, v.docweb_id) >= x GROUP BY verdict"""
)
def first_selected(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts up to the two hundredth document kept, newest first; what comes after it isn't looked at."""
    return documents.select_documents(table(spark, d, "docs"), 200, language=False).groupBy("verdict").agg(F.count("*").alias("docs"))


@query("SELECT body_sha256, max((coalesce(date, ''), docweb_id))[2] AS docweb_id, count(*) AS copies FROM docs WHERE body_sha256 IS NOT NULL GROUP BY body_sha256")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "docs").where("body_sha256 is not null").groupBy("body_sha256")
    return g.agg(F.max_by("docweb_id", F.struct(F.coalesce("date", F.lit("")), F.col("docweb_id"))).alias("docweb_id"), F.count("*").alias("copies"))


_W = r"regexp_extract_all(regexp_replace(regexp_replace(lower(body), '[0-9]+', '0', 'g'), '\bx{2,}\b|\[omissis\]', 'x', 'g'), '[\p{L}\p{M}\p{N}_]+')"
_SETS = rf"""w AS (SELECT docweb_id, any_value({_W}) AS w, any_value(coalesce(date, '')) AS date FROM docs WHERE docweb_id IS NOT NULL GROUP BY docweb_id),
  s AS (SELECT docweb_id, list_distinct([hash(array_to_string(w[i:i + 4], ' ')) for i in range(1, greatest(2, len(w) - 3))]) AS s FROM w WHERE len(w) > 0)"""


@query(f"WITH {_SETS} SELECT docweb_id, len(s) AS n FROM s")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents.shingles(table(spark, d, "docs")).select(F.col("id").alias("docweb_id"), F.size("s").cast("bigint").alias("n"))


@query()
def minhash_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Buckets that more than one document falls into; minima of random hashes have no SQL."""
    b = documents.minhash_bands(documents.shingles(table(spark, d, "docs")))
    return b.groupBy("band", "key").agg(F.count("*").alias("docs"), F.min("id").alias("first")).where("docs > 1")


@query(
    f"""WITH RECURSIVE {_SETS}, e AS (SELECT docweb_id, len(s) AS n, unnest(s) AS g FROM s),
      c AS (SELECT x.docweb_id AS a, y.docweb_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common FROM e x JOIN e y ON x.g = y.g AND x.docweb_id < y.docweb_id GROUP BY ALL),
      p AS (SELECT a, b FROM c WHERE common >= 0.7 * (na + nb - common) - 1e-9), both_ways AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT docweb_id, docweb_id FROM w),
      reach AS (SELECT a AS docweb_id, a AS m FROM both_ways UNION SELECT r.docweb_id, k.b FROM reach r JOIN both_ways k ON r.m = k.a)
      SELECT r.docweb_id, max((w.date, w.docweb_id))[2] AS representative FROM reach r JOIN w ON w.docweb_id = r.m GROUP BY r.docweb_id"""
)
def neardup_families(spark: SparkSession, d: str) -> DataFrame:
    return documents.families(table(spark, d, "docs"))


@query(
    r"""WITH p AS (SELECT DISTINCT docweb_id, trim(regexp_replace(unnest(regexp_split_to_array(body, '\r\n|\n|\r')), '[\s\x{A0}]+', ' ', 'g')) AS p FROM docs)
      SELECT trim(regexp_replace(regexp_replace(lower(p), '[0-9]+', '0', 'g'), '\s+', ' ', 'g')) AS key, count(DISTINCT docweb_id) AS docs FROM p WHERE length(p) >= 60 GROUP BY 1 HAVING count(DISTINCT docweb_id) >= 5"""
)
def repeated_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of sixty characters or more in at least five documents; boilerplate_keys is the same over joined paragraphs."""
    p = table(spark, d, "docs").select("docweb_id", F.explode(C.lines(F.col("body"))).alias("p")).where("length(p) >= 60")
    return p.groupBy(C.paragraph_key(F.col("p")).alias("key")).agg(F.count_distinct("docweb_id").alias("docs")).where("docs >= 5")


@query()
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return documents.paragraphs(documents.outlines(table(spark, d, "docs")))


@query()
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return documents.sentences(documents.outlines(table(spark, d, "docs")))


@query()
def boilerplate_keys(spark: SparkSession, d: str) -> DataFrame:
    return documents.Mined(table(spark, d, "docs")).keys


@query()
def procedural_phrases(spark: SparkSession, d: str) -> DataFrame:
    m = documents.Mined(table(spark, d, "docs"))
    return documents.phrase_texts(documents.sentence_phrases(m.reps, m.boiler), m.procedural)


@query()
def built_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Selection, families, mining and chunks in one go."""
    return documents.build_index(table(spark, d, "docs"))[0]


@query()
def index_figures(spark: SparkSession, d: str) -> DataFrame:
    return documents.build_index(table(spark, d, "docs"))[2]


@query()
def dropped_words(spark: SparkSession, d: str) -> DataFrame:
    return documents.dropped_words(documents.Mined(table(spark, d, "docs")).formulas)


# ------------------------------------------------------------------------------------------- fields and figures

_ISO = r"""CASE WHEN regexp_matches(trim(list_date), '^[0-9]{2}/[0-9]{2}/([0-9]{2}|[0-9]{4})$') THEN strftime(try_cast(
  (CASE WHEN length(trim(list_date)) = 10 THEN substr(trim(list_date), 7) WHEN substr(trim(list_date), 7) >= '90' THEN '19' || substr(trim(list_date), 7) ELSE '20' || substr(trim(list_date), 7) END)
  || '-' || substr(trim(list_date), 4, 2) || '-' || substr(trim(list_date), 1, 2) AS DATE), '%Y-%m-%d') END"""


@query(f"SELECT log_id, {_ISO} AS date, CASE WHEN {_ISO} < '2018-05-25' THEN 'pre_gdpr' WHEN {_ISO} >= '2018-05-25' THEN 'gdpr' END AS era FROM docs_state")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "docs_state").select("log_id", C.iso_date(F.col("list_date")).alias("date"))
    return s.withColumn("era", C.era(F.col("date")))


@query(
    rf"""WITH f AS (SELECT docweb_id, body, regexp_extract_all(body, '{it.FINE}', 1) AS w, regexp_extract_all(body, '{it.FINE}', 2) AS c FROM docs)
      SELECT docweb_id, array_to_string(list_sort(list_distinct([(replace(w[i], '.', '') || '.' || CASE WHEN coalesce(c[i], '') = '' THEN '00' ELSE c[i] END)::DOUBLE::BIGINT for i in range(1, len(w) + 1)])), ',') AS fines,
        try_cast(nullif(regexp_extract(body, '{it.REGISTRO}', 1), '') AS INTEGER)::VARCHAR AS registro_n,
        array_to_string(list_sort(list_distinct(list_filter([x::BIGINT for x in regexp_extract_all(body, '{it.DOCWEB_TEXT}', 1)], lambda x: x <> docweb_id))), ',') AS refs,
        len(regexp_extract_all(body, '\bXX\b')) AS placeholders FROM f"""
)
def extracted_fields(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",")
    return table(spark, d, "docs").select("docweb_id", joined(C.fines(b)).alias("fines"), C.registro(b).cast("string").alias("registro_n"), joined(C.references(b, F.col("docweb_id"))).alias("refs"), C.placeholders(b).cast("bigint").alias("placeholders"))


@query(
    """WITH x AS (SELECT *, list_max(fines_eur) AS fine, ceil(body_chars / 1600) AS ch, len(list_distinct(list_concat(coalesce(cites, []), coalesce(refs_in_text, [])))) AS e FROM docs)
      SELECT count(*) AS documents, count(*) FILTER (body_chars < 300) AS suspect_short_bodies, (sum(body_chars) // 4)::BIGINT AS approx_tokens, sum(ch)::BIGINT AS est_chunks, round(sum(ch) * 1024 * 2 / 1e6, 1) AS est_vector_mb,
        count(*) FILTER (coalesce(date, '') = '') AS missing_date, count(fine) AS docs_with_fine, median(fine) AS fine_median, max(fine) AS fine_max, count(*) FILTER (len(attachments) > 0) AS docs_with_attachments,
        count(*) FILTER (noarchive) AS noarchive_pages, count(*) FILTER (xx_placeholders > 0) AS docs_with_pseudonyms, sum(e)::BIGINT AS citation_edges FROM x"""
)
def corpus_figures(spark: SparkSession, d: str) -> DataFrame:
    return analysis.corpus_figures(table(spark, d, "docs"))


@query("SELECT substr(CASE WHEN coalesce(date, '') = '' THEN '????' ELSE date END, 1, 4) AS year, count(*) AS docs FROM docs GROUP BY 1")
def docs_by_year(spark: SparkSession, d: str) -> DataFrame:
    return analysis.by_year(table(spark, d, "docs"))


@query("SELECT era, body_method, count(*) AS docs FROM docs GROUP BY ALL")
def docs_by_era_and_method(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").groupBy("era", "body_method").agg(F.count("*").alias("docs"))


@query("WITH t AS (SELECT unnest(argomenti) AS label FROM docs) SELECT label, count(*) AS docs FROM t GROUP BY label ORDER BY docs DESC, label LIMIT 40")
def topics_top40(spark: SparkSession, d: str) -> DataFrame:
    return analysis.counts_by(table(spark, d, "docs"), "argomenti", 40)


@query("WITH t AS (SELECT unnest(tipologia) AS label FROM docs) SELECT label, count(*) AS docs FROM t GROUP BY label")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return analysis.counts_by(table(spark, d, "docs"), "tipologia")


@query("SELECT DISTINCT t.label FROM (SELECT unnest(tipologia) AS label FROM chunks) t WHERE t.label IS NOT NULL")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.explode("tipologia").alias("label")).where("label is not null").distinct()


@query("SELECT min(y) AS first_year, max(y) AS last_year FROM (SELECT coalesce(try_cast(substr(date, 1, 4) AS INTEGER), 0) AS y FROM chunks) WHERE y > 0")
def year_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(C.year(F.col("date")).alias("y")).where("y > 0").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"))


@query(
    """WITH s AS (SELECT body_chars AS x, row_number() OVER (ORDER BY body_chars) - 1 AS i, count(*) OVER () AS n FROM docs WHERE body_chars IS NOT NULL)
      SELECT max(x) FILTER (i = least(n - 1, floor(0.1 * n))) AS p10, max(x) FILTER (i = least(n - 1, floor(0.5 * n))) AS p50, max(x) FILTER (i = least(n - 1, floor(0.9 * n))) AS p90, max(x) AS longest FROM s"""
)
def body_length_picks(spark: SparkSession, d: str) -> DataFrame:
    return analysis.picks(table(spark, d, "docs"), "body_chars", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "longest": 1.0}, False)


@query(
    """WITH s AS (SELECT n_tokens AS x, row_number() OVER (ORDER BY n_tokens) - 1 AS i, count(*) OVER () AS n FROM chunks WHERE n_tokens IS NOT NULL)
      SELECT max(x) FILTER (i = floor(0.1 * (n - 1))) AS p10, max(x) FILTER (i = floor(0.5 * (n - 1))) AS p50, max(x) FILTER (i = floor(0.9 * (n - 1))) AS p90, max(x) AS longest FROM s"""
)
def chunk_token_picks(spark: SparkSession, d: str) -> DataFrame:
    return analysis.picks(table(spark, d, "chunks"), "n_tokens", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "longest": 1.0}, True)


@query("SELECT section, count(*) AS chunks, sum(n_tokens)::BIGINT AS tokens, round(avg(weight), 6) AS weight FROM chunks GROUP BY section")
def chunks_by_section(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("section").agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"), F.round(F.avg("weight"), 6).alias("weight"))


@query(
    r"""SELECT chunk_id, CASE WHEN length(text) <= 700 THEN text ELSE regexp_replace(substr(text, 1, 700), '(?s) [^ ]*$', '') || ' …' END AS shown, regexp_replace(title, '([\[\]*_`$])', '\\\1', 'g') AS link,
      left(list_last(string_split(heading, ' > ')), 120) AS heading FROM chunks"""
)
def passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", C.passage(F.col("text")).alias("shown"), C.escape_markdown(F.col("title")).alias("link"), F.left(F.element_at(F.split("heading", " > "), -1), F.lit(120)).alias("heading"))


# ------------------------------------------------------------------------------------------------ graph, vectors

_EDGES = """nodes AS (SELECT DISTINCT docweb_id FROM chunks WHERE docweb_id IS NOT NULL),
  via AS (SELECT similar_docweb_id AS t, min(docweb_id) AS node FROM duplicates WHERE docweb_id IN (SELECT docweb_id FROM nodes) AND similar_docweb_id IS NOT NULL AND similar_docweb_id NOT IN (SELECT docweb_id FROM nodes) GROUP BY 1),
  place AS (SELECT docweb_id AS t, docweb_id AS node FROM nodes UNION ALL SELECT t, node FROM via),
  c AS (SELECT docweb_id AS a, unnest(list_concat(list_concat(coalesce(cites, []), coalesce(see_also, [])), coalesce(refs_in_text, []))) AS t FROM docs WHERE docweb_id IN (SELECT docweb_id FROM nodes)),
  edges AS (SELECT DISTINCT least(a, node) AS src, greatest(a, node) AS dst FROM c JOIN place USING (t) WHERE a <> node)"""
_VEC = """one AS (SELECT chunk_id, any_value(docweb_id) AS docweb_id, any_value(embedding) AS v FROM chunks WHERE len(embedding) = 64 AND docweb_id IS NOT NULL GROUP BY chunk_id),
  dims AS (SELECT docweb_id, i, sum(v[i]::DOUBLE) AS x FROM one, range(1, 65) t(i) WHERE list_inner_product(v, v) > 0 GROUP BY ALL),
  sums AS (SELECT docweb_id, list(x ORDER BY i) AS s FROM dims GROUP BY docweb_id),
  vec AS (SELECT docweb_id, s, sqrt(list_inner_product(s, s)) AS l FROM sums WHERE list_inner_product(s, s) > 0)"""
_LINKED = f"{_EDGES}, {_VEC}, linked AS (SELECT src, dst, list_inner_product(x.s, y.s) / x.l / y.l AS cosine FROM edges JOIN vec x ON x.docweb_id = src JOIN vec y ON y.docweb_id = dst)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return analysis.citation_edges(table(spark, d, "docs"), table(spark, d, "chunks"), table(spark, d, "duplicates"))


@query(f"WITH {_EDGES} SELECT src, dst FROM edges")
def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"WITH {_EDGES}, rules AS (SELECT docweb_id FROM docs WHERE len(list_filter(tipologia, lambda t: contains(lower(t), 'regolamento del garante'))) > 0) SELECT src, dst FROM edges WHERE src NOT IN (SELECT docweb_id FROM rules) AND dst NOT IN (SELECT docweb_id FROM rules)")
def citation_edges_on_cases(spark: SparkSession, d: str) -> DataFrame:
    return analysis.without_procedural(_edges(spark, d), table(spark, d, "docs"))


@query(f"WITH {_VEC} SELECT docweb_id, round(s[1] / l, 5) AS first, round(s[64] / l, 5) AS last, round(list_sum(s) / l, 5) AS total FROM vec")
def doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = analysis.doc_vectors(table(spark, d, "chunks"))
    return v.select("docweb_id", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.get("v", F.lit(63)), 5).alias("last"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"WITH {_LINKED} SELECT src, dst, round(cosine, 6) AS cosine FROM linked")
def linked_cosines(spark: SparkSession, d: str) -> DataFrame:
    return analysis.linked_cosines(analysis.doc_vectors(table(spark, d, "chunks")), _edges(spark, d)).withColumn("cosine", F.round("cosine", 6))


@query(
    f"""WITH {_LINKED}, ways AS (SELECT src, dst, round(cosine, 9) AS c FROM linked UNION ALL SELECT dst, src, round(cosine, 9) FROM linked)
      SELECT w.src, w.dst, 1 + count(*) FILTER (y.docweb_id <> w.src AND round(list_inner_product(x.s, y.s) / x.l / y.l, 9) > w.c) AS rank FROM ways w JOIN vec x ON x.docweb_id = w.src, vec y GROUP BY w.src, w.dst"""
)
def link_ranks(spark: SparkSession, d: str) -> DataFrame:
    return analysis.link_ranks(materialise(analysis.doc_vectors(table(spark, d, "chunks")), "vec"), materialise(_edges(spark, d), "edges"))


@query(
    f"""WITH {_LINKED}, b AS (SELECT greatest(0, least(39, floor((cosine + 1) / 0.05)))::INTEGER AS bin FROM linked)
      SELECT bin, round(count(*) / ((SELECT count(*) FROM b) * 0.05), 6) AS density FROM b GROUP BY bin"""
)
def linked_histogram(spark: SparkSession, d: str) -> DataFrame:
    s = analysis.linked_cosines(analysis.doc_vectors(table(spark, d, "chunks")), _edges(spark, d))
    return analysis.histogram(s, "cosine", -1.0, 1.0).withColumn("density", F.round("density", 6))


@query(
    """WITH one AS (SELECT chunk_id, any_value(argomenti) AS a FROM chunks GROUP BY chunk_id), h AS (SELECT DISTINCT query_id, chunk_id, lexical FROM hits WHERE lexical IS NOT NULL),
      s AS (SELECT lexical, coalesce(list_has_any(q.tags, one.a), false) AS rel FROM h JOIN one USING (chunk_id) JOIN queries q USING (query_id)),
      r AS (SELECT rel, rank() OVER (ORDER BY lexical) + (count(*) OVER (PARTITION BY lexical) - 1) / 2 AS rk FROM s)
      SELECT round((sum(rk) FILTER (rel) - count(*) FILTER (rel) * (count(*) FILTER (rel) + 1) / 2) / count(*) FILTER (rel) / count(*) FILTER (NOT rel), 6) AS auc FROM r"""
)
def auc_keyword_relevance(spark: SparkSession, d: str) -> DataFrame:
    """How well the keyword score tells hits on a query's topics from others."""
    h = table(spark, d, "hits").where("lexical is not null").select("query_id", "chunk_id", "lexical").distinct()
    s = h.join(search.distinct_chunks(table(spark, d, "chunks")).select("chunk_id", "argomenti"), "chunk_id").join(table(spark, d, "queries").select("query_id", "tags"), "query_id")
    s = s.select("lexical", F.coalesce(F.arrays_overlap("tags", "argomenti"), F.lit(False)).alias("rel"))
    return analysis.auc(s.where("rel"), s.where("not rel"), "lexical").withColumn("auc", F.round("auc", 6))


@query()
def graph_figures(spark: SparkSession, d: str) -> DataFrame:
    """Linked against random pairs; the pairs are drawn by a hash that SQL doesn't have."""
    v = materialise(analysis.doc_vectors(table(spark, d, "chunks")), "vec")
    return analysis.graph_figures(v, materialise(analysis.without_procedural(_edges(spark, d), table(spark, d, "docs")), "edges"))


@query()
def embedding_map(spark: SparkSession, d: str) -> DataFrame:
    return analysis.pca_2d(analysis.doc_vectors(table(spark, d, "chunks")))[0]


@query(
    f"""WITH {_LINKED}, ways AS (SELECT src, dst, round(cosine, 9) AS c FROM linked UNION ALL SELECT dst, src, round(cosine, 9) FROM linked),
      ranks AS (SELECT w.src, w.dst, 1 + count(*) FILTER (y.docweb_id <> w.src AND round(list_inner_product(x.s, y.s) / x.l / y.l, 9) > w.c) AS rank FROM ways w JOIN vec x ON x.docweb_id = w.src, vec y GROUP BY w.src, w.dst)
      SELECT round((SELECT avg((rank <= 10)::DOUBLE) FROM ranks), 6) AS recall10, (SELECT median(rank) FROM ranks)::DOUBLE AS median_rank, round((SELECT median(cosine) FROM linked), 5) AS median_linked"""
)
def link_closeness(spark: SparkSession, d: str) -> DataFrame:
    """The figures of the graph that need no random pairs."""
    v, e = materialise(analysis.doc_vectors(table(spark, d, "chunks")), "vec"), materialise(_edges(spark, d), "edges")
    near = analysis.link_ranks(v, e).agg(F.round(F.avg((F.col("rank") <= 10).cast("double")), 6).alias("recall10"), F.median("rank").cast("double").alias("median_rank"))
    return near.join(analysis.linked_cosines(v, e).agg(F.round(F.median("cosine"), 5).alias("median_linked")))


@query(
    """WITH one AS (SELECT docweb_id, arg_min(struct_pack(t := title, d := date, ty := tipologia, ar := argomenti, s := similar_count, c := chunk_id), chunk_index) AS x FROM chunks WHERE docweb_id IS NOT NULL AND chunk_index IS NOT NULL GROUP BY docweb_id)
      SELECT docweb_id, x.t AS title, x.d AS date, array_to_string(x.ty, ', ') AS types, array_to_string(x.ar[1:3], ', ') AS topics, x.s AS similar_count, x.c AS first_chunk FROM one"""
)
def map_nodes(spark: SparkSession, d: str) -> DataFrame:
    return analysis.map_nodes(table(spark, d, "chunks"))


@query(
    f"""WITH {_LINKED}, lim AS (SELECT min(cosine) AS lo, max(cosine) AS hi FROM linked), b AS (SELECT least(39, floor((cosine - lo) / ((hi - lo) / 40)))::INTEGER AS bin, (hi - lo) / 40 AS w FROM linked, lim)
      SELECT bin, round(count(*) / ((SELECT count(*) FROM b) * any_value(w)), 4) AS density FROM b GROUP BY bin"""
)
def joint_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Bins over the range of the scores themselves."""
    s = materialise(analysis.linked_cosines(analysis.doc_vectors(table(spark, d, "chunks")), _edges(spark, d)), "linked")
    return analysis.histogram(s, "cosine").withColumn("density", F.round("density", 4))


@query("SELECT 'docs' AS name, count(*) AS n, round(sum(strlen(body)) / 1e6, 3) AS mb FROM docs UNION ALL SELECT 'chunks', count(*), round(sum(strlen(text)) / 1e6, 3) FROM chunks")
def text_sizes(spark: SparkSession, d: str) -> DataFrame:
    return analysis.text_size(table(spark, d, "docs"), "docs", "body").unionByName(analysis.text_size(table(spark, d, "chunks"), "chunks", "text"))


# ------------------------------------------------------------------------------------------------- state, export

_STATE = """st AS (SELECT docweb_id, arg_max(struct_pack(title, list_date, tipologia, argomenti, listing_text, fetch_status, fetched_at, raw_sha256), (written_at, log_id)) AS s, min(first_seen) AS first_seen FROM docs_state WHERE docweb_id IS NOT NULL GROUP BY docweb_id)"""


@query(f"WITH {_STATE} SELECT docweb_id, s.title AS title, s.list_date AS list_date, s.fetch_status::VARCHAR AS fetch_status, s.raw_sha256 AS raw_sha256, epoch_us(first_seen)::VARCHAR AS first_seen, epoch_us(s.fetched_at)::VARCHAR AS fetched_at FROM st")
def current_state(spark: SparkSession, d: str) -> DataFrame:
    s = state.current_state(table(spark, d, "docs_state"))
    text = lambda c: c.cast("string")
    return s.select("docweb_id", "title", "list_date", text(F.col("fetch_status")).alias("fetch_status"), "raw_sha256", text(F.unix_micros("first_seen")).alias("first_seen"), text(F.unix_micros("fetched_at")).alias("fetched_at"))


@query(f"WITH {_STATE} SELECT docweb_id FROM st WHERE s.fetch_status IS NULL OR s.fetch_status NOT IN (200, 404, -1)")
def work_queue(spark: SparkSession, d: str) -> DataFrame:
    return state.work_queue(state.current_state(table(spark, d, "docs_state")))


@query(
    """WITH old AS (SELECT docweb_id, arg_max(title, (written_at, log_id)) AS title, min(first_seen) AS first_seen, arg_max(fetch_status, (written_at, log_id)) AS st FROM docs_state WHERE docweb_id IS NOT NULL AND written_at < TIMESTAMPTZ '2024-01-01 00:00:00+00' GROUP BY docweb_id),
      new AS (SELECT docweb_id, arg_max(title, log_id) AS title FROM docs_state WHERE docweb_id IS NOT NULL AND written_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00' GROUP BY docweb_id)
      SELECT docweb_id, CASE WHEN new.docweb_id IS NOT NULL THEN new.title ELSE old.title END AS title, epoch_us(coalesce(old.first_seen, CASE WHEN new.docweb_id IS NOT NULL THEN TIMESTAMPTZ '2025-01-01 00:00:00+00' END)) AS first_seen FROM old FULL JOIN new USING (docweb_id)"""
)
def upsert_listing(spark: SparkSession, d: str) -> DataFrame:
    """Listings written from 2024 on, merged into the state before."""
    import datetime as dt

    log, edge = table(spark, d, "docs_state"), F.to_timestamp(F.lit("2024-01-01 00:00:00+00:00"))
    now = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    s = state.upsert_listing(state.current_state(log.where(F.col("written_at") < edge)), log.where(F.col("written_at") >= edge).withColumn("item_no", F.col("log_id")), now)
    return s.select("docweb_id", "title", F.unix_micros("first_seen").alias("first_seen"))


@query("WITH c AS (SELECT unnest(list_concat(list_concat(coalesce(cites, []), coalesce(see_also, [])), coalesce(refs_in_text, []))) AS docweb_id FROM docs) SELECT DISTINCT docweb_id FROM c WHERE docweb_id IS NOT NULL AND docweb_id NOT IN (SELECT docweb_id FROM docs WHERE docweb_id IS NOT NULL UNION SELECT docweb_id FROM docs_state WHERE docweb_id IS NOT NULL)")
def unknown_ids(spark: SparkSession, d: str) -> DataFrame:
    """Cited documents that neither the corpus nor the crawl knows."""
    docs = table(spark, d, "docs")
    none = F.array().cast("array<bigint>")
    cited = docs.select(F.explode(F.concat(*(F.coalesce(c, none) for c in ("cites", "see_also", "refs_in_text")))).alias("docweb_id"))
    return state.unknown_ids(cited, docs, table(spark, d, "docs_state")).select("docweb_id")


@query(
    """WITH p AS (SELECT log_id // 40 AS page, docweb_id FROM docs_state WHERE docweb_id IS NOT NULL), known AS (SELECT docweb_id FROM docs_state WHERE written_at < TIMESTAMPTZ '2023-01-01 00:00:00+00' AND docweb_id IS NOT NULL),
      c AS (SELECT page, count(*) FILTER (docweb_id NOT IN (SELECT docweb_id FROM known)) AS new FROM p GROUP BY page), stop AS (SELECT min(page) AS page FROM c WHERE new = 0)
      SELECT c.page, new FROM c, stop WHERE c.page <= coalesce(stop.page, c.page)"""
)
def listing_until_known(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a listing up to the first that brings nothing new."""
    log = table(spark, d, "docs_state")
    return state.until_known(log.withColumn("page", F.floor(F.col("log_id") / 40)), log.where(F.col("written_at") < F.to_timestamp(F.lit("2023-01-01 00:00:00+00:00"))))


@query("SELECT DISTINCT docweb_id FROM chunks WHERE docweb_id IS NOT NULL AND docweb_id NOT IN (SELECT docweb_id FROM docs WHERE docweb_id IS NOT NULL)")
def missing_documents(spark: SparkSession, d: str) -> DataFrame:
    return export.missing_documents(table(spark, d, "docs"), table(spark, d, "chunks"))


@query(
    """WITH o AS (SELECT docweb_id, any_value(title) AS title, any_value(date) AS date, any_value(tipologia) AS ty, any_value(argomenti) AS ar, any_value(length(body)) AS body_chars FROM docs WHERE docweb_id IN (SELECT docweb_id FROM chunks) GROUP BY docweb_id),
      t AS (SELECT docweb_id, count(*) AS twins FROM (SELECT DISTINCT docweb_id, similar_docweb_id, date, title, url FROM duplicates WHERE docweb_id IS NOT NULL AND similar_docweb_id IS NOT NULL) GROUP BY docweb_id)
      SELECT o.docweb_id AS id, title, strftime(try_cast(date AS DATE), '%Y-%m-%d') AS date, array_to_string(ty, ', ') AS types, array_to_string(ar[1:3], ', ') AS topics, coalesce(twins, 0) AS twins, body_chars FROM o LEFT JOIN t USING (docweb_id)"""
)
def exported_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = export.decisions(table(spark, d, "docs"), table(spark, d, "chunks"), table(spark, d, "duplicates"))
    return e.select("id", "title", F.date_format("date", "yyyy-MM-dd").alias("date"), F.array_join("types", ", ").alias("types"), F.array_join(F.slice("topics", 1, 3), ", ").alias("topics"), F.size("similar_decisions").cast("bigint").alias("twins"), F.length("body").cast("bigint").alias("body_chars"))


@query(
    rf"""SELECT chunk_id AS id, docweb_id AS decision_id, chunk_index AS idx, section, coalesce(heading, '') AS heading, weight, try_cast(substr(date, 1, 4) AS INTEGER)::VARCHAR AS year, array_to_string(tipologia, '|') AS types,
      coalesce(list_has_any(tipologia, [{_CASES}]), false) AS is_case, regexp_replace(split_part(embed_text, chr(10) || chr(10), 1), '{it.HEADER_LABELS}', '', 'g') AS header, text FROM chunks"""
)
def exported_chunks(spark: SparkSession, d: str) -> DataFrame:
    return export.chunk_rows(table(spark, d, "chunks")).withColumn("year", F.col("year").cast("string")).withColumn("types", F.array_join("types", "|")).drop("embedding")


@query(
    """WITH one AS (SELECT chunk_id, any_value(docweb_id) AS docweb_id, any_value(section) AS section, any_value(weight) AS weight FROM chunks GROUP BY chunk_id),
      a AS (SELECT docweb_id, dense_rank() OVER (ORDER BY docweb_id) - 1 AS decision_code FROM (SELECT DISTINCT docweb_id FROM one WHERE docweb_id IS NOT NULL)), b AS (SELECT section, (dense_rank() OVER (ORDER BY section) - 1)::INTEGER AS section_code FROM (SELECT DISTINCT section FROM one WHERE section IS NOT NULL))
      SELECT chunk_id, decision_code, section_code, coalesce(weight, 1.0) AS weight FROM one LEFT JOIN a USING (docweb_id) LEFT JOIN b USING (section)"""
)
def dictionary_codes(spark: SparkSession, d: str) -> DataFrame:
    return export.coded_chunks(table(spark, d, "chunks"))


@query(f"WITH {_TF} SELECT term AS word, df AS ndoc FROM df")
def lexeme_stats_forms(spark: SparkSession, d: str) -> DataFrame:
    return export.lexeme_stats(table(spark, d, "chunks"), stemmed=False)


@query()
def lexeme_stats(spark: SparkSession, d: str) -> DataFrame:
    return export.lexeme_stats(table(spark, d, "chunks"))


@query()
def vectors_by_file(spark: SparkSession, d: str) -> DataFrame:
    v = export.vectors_by_file(table(spark, d, "chunks"), F.col("chunk_id"), max_bytes=1 << 20)
    return v.groupBy("part").agg(F.count("*").alias("vectors"), F.min("ord").alias("first"))
