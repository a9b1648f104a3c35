"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import contamination, distinctive, fusion, groups, mixing, near_duplicates, neighbours, repeated_lines, truncation
from corpuscle.sources.tables import table

#: The vocabulary of a public tokenizer; where it lies is up to the installation.
TOKENIZER = os.environ.get("CORPUSCLE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Every score counts as much as the others.
WEIGHTS = {"closeness": 1.0, "lexical": 1.0, "weight": 1.0}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    scores = distinctive.term_scores(table(spark, d, "chunks"), "chunk_id", "text")
    return scores.where("tf >= 3 and df between 2 and 8").select(F.col("id").alias("chunk_id"), "term")


def p2_term_scores(spark: SparkSession, d: str) -> DataFrame:
    s = distinctive.term_scores(table(spark, d, "chunks"), "chunk_id", "text")
    return s.select(F.col("id").alias("chunk_id"), "term", F.col("tf").cast("long").alias("tf"), "df", F.round("score", 6).alias("score"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    hits = fusion.score_hits(table(spark, d, "hits"), table(spark, d, "chunks"), table(spark, d, "queries"))
    return fusion.fuse_scores(hits, "query_id", "chunk_id", WEIGHTS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the whole ranking that few others surpass in any score."""
    few = " and ".join(f"{k}_higher < 10" for k in WEIGHTS)
    return _fused(spark, d).where(f"{few} and fused is not null and position >= 1").select("query_id", "chunk_id")


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "chunk_id", F.round("closeness", 6).alias("closeness"), "lexical", "weight", F.round("fused", 6).alias("fused"), "position")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.mine_lines(table(spark, d, "docs"))[0].select("docweb_id", "line_no")


def p4_templates(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.mine_lines(table(spark, d, "docs"))[1]


def p4_clean_bodies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").select("docweb_id", "url", "body")
    return repeated_lines.without_lines(docs, repeated_lines.mine_lines(docs)[0]).select("docweb_id", "clean_body").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbours.similar_pairs(table(spark, d, "chunks"), "chunk_id", "embedding", 0.95)
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b")).distinct()


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For every vector its representative, the smallest id with an equal vector, and the ten representatives nearest to that.

    A representative without neighbours keeps its rows, with nulls. The copies of a neighbour are the rows with that representative."""
    reps, members = neighbours.unit_classes(table(spark, d, "chunks"), "chunk_id", "embedding", 64)
    found = neighbours.nearest_of_members(members, neighbours.nearest(reps, 10))
    return found.select(F.col("id").alias("chunk_id"), F.col("rep").alias("representative"), F.col("other").alias("similar_chunk_id"), F.round("cosine", 5).alias("cosine"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.match_groups(table(spark, d, "duplicates"), "docweb_id", "similar_docweb_id").select(F.col("id").alias("docweb_id"), "group_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").where("body_chars >= 300")
    pairs, members = near_duplicates.near_duplicates(docs, "docweb_id", "body", 0.7)
    return near_duplicates.expand_pairs(pairs, members).select(F.col("a").alias("docweb_id_a"), F.col("b").alias("docweb_id_b")).distinct()


def p7_families(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its family: representatives linked by a similarity of 0.8 or more, and their copies."""
    pairs, members = near_duplicates.near_duplicates(table(spark, d, "docs"), "docweb_id", "body", 0.8)
    fam = groups.match_groups(pairs, "a", "b")
    return members.join(fam, members.rep == fam.id, "left").select(members.id.alias("docweb_id"), F.coalesce("group_id", "rep").alias("family"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where("run >= 12").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of either kind: shared runs, and edited copies by their alignment."""
    found = contamination.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "run", F.round("score", 3).alias("score"), F.round("share", 4).alias("share"))


def p9_mix_records(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=TOKENIZER)[0]


def p9_mix_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), tokenizer=TOKENIZER)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).select("doc_id").distinct()


def p10_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_by_source(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_term_scores, p3_found, p3_ranking, p4_found, p4_templates, p4_clean_bodies, p5_found, p5_nearest, p6_found, p7_found, p7_families, p8_found, p8_leaks, p9_mix_records, p9_mix_report, p10_found, p10_by_source)}

_TERMS = """
one AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
words AS (SELECT chunk_id, unnest(regexp_extract_all(nfc_normalize(lower(nfc_normalize(text))), '\\p{L}+')) AS term FROM one),
tfs AS (SELECT chunk_id, term, count(*) AS tf FROM words GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term)"""

_KINDS = """
one AS (SELECT chunk_id, max(weight) AS weight, max(embedding) AS cv FROM chunks GROUP BY chunk_id),
q AS (SELECT query_id, max(embedding) AS qv FROM queries GROUP BY query_id),
h AS (SELECT query_id, chunk_id, max(lexical) AS lexical FROM hits WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
s AS (SELECT h.query_id, h.chunk_id, h.lexical, one.weight,
  CASE WHEN len(cv) = len(qv) AND list_inner_product(cv::DOUBLE[], cv::DOUBLE[]) > 0 AND list_inner_product(qv::DOUBLE[], qv::DOUBLE[]) > 0
    THEN list_inner_product(cv::DOUBLE[], qv::DOUBLE[]) / sqrt(list_inner_product(cv::DOUBLE[], cv::DOUBLE[])) / sqrt(list_inner_product(qv::DOUBLE[], qv::DOUBLE[])) END AS closeness
  FROM h LEFT JOIN one USING (chunk_id) LEFT JOIN q USING (query_id)),
r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY closeness DESC NULLS LAST) AS c, rank() OVER (PARTITION BY query_id ORDER BY lexical DESC NULLS LAST) AS l, rank() OVER (PARTITION BY query_id ORDER BY weight DESC NULLS LAST) AS w FROM s)"""

_NORMAL = """CASE WHEN least(p, 1 - p) < 0.02425 THEN sign(p - 0.5) * -(((((-7.784894002430293e-03 * t - 3.223964580411365e-01) * t - 2.400758277161838e00) * t - 2.549732539343734e00) * t + 4.374664141464968e00) * t + 2.938163982698783e00)
    / ((((7.784695709041462e-03 * t + 3.224671290700398e-01) * t + 2.445134137142996e00) * t + 3.754408661907416e00) * t + 1)
  ELSE (((((-3.969683028665376e01 * r + 2.209460984245205e02) * r - 2.759285104469687e02) * r + 1.383577518672690e02) * r - 3.066479806614716e01) * r + 2.506628277459239e00) * (p - 0.5)
    / (((((-5.447609879822406e01 * r + 1.615858368580409e02) * r - 1.556989798598866e02) * r + 6.680131188771972e01) * r - 1.328068155288572e01) * r + 1) END"""
_FUSED = f"""{_KINDS},
long AS (SELECT query_id, chunk_id, unnest([(1, closeness), (2, lexical), (3, weight)]) AS x FROM s),
perc AS (SELECT query_id, chunk_id, (count(*) OVER (PARTITION BY query_id, x[1]) - (rank() OVER (PARTITION BY query_id, x[1] ORDER BY x[2] DESC) - 1) - count(*) OVER (PARTITION BY query_id, x[1], x[2]) / 2) / count(*) OVER (PARTITION BY query_id, x[1]) AS p FROM long WHERE x[2] IS NOT NULL),
z AS (SELECT query_id, chunk_id, {_NORMAL} AS z FROM (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t, (p - 0.5) * (p - 0.5) AS r FROM perc)),
fused AS (SELECT query_id, chunk_id, round(sum(z) / count(*), 12) AS fused FROM z GROUP BY ALL)"""

_LINES = r"""
d AS (SELECT DISTINCT docweb_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS site, body FROM docs),
numbered AS (SELECT docweb_id, site, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM d),
keyed AS (SELECT docweb_id, site, line_no, regexp_replace(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\s\x{A0}]+', ' ', 'g'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS key FROM numbered),
sizes AS (SELECT site, count(DISTINCT docweb_id) AS n FROM d GROUP BY site),
often AS (SELECT site, key FROM keyed JOIN sizes USING (site) WHERE key <> '' GROUP BY site, key, n HAVING count(DISTINCT docweb_id) >= 5 AND count(DISTINCT docweb_id) >= 0.1 * n)"""

_WORDS7 = r"regexp_extract_all(regexp_replace(regexp_replace(lower(body), '[0-9]+', '0', 'g'), '\bx{2,}\b|\[omissis\]', 'x', 'g'), '[\p{L}\p{N}_]+')"

_SHINGLES = rf"""
b AS (SELECT docweb_id, max(body) AS body FROM docs WHERE body_chars >= 300 GROUP BY docweb_id),
w AS (SELECT docweb_id, {_WORDS7} AS w FROM b),
s AS (SELECT docweb_id, list_distinct([hash(array_to_string(w[i:i + 4], ' ')) for i in range(1, greatest(2, len(w) - 3))]) AS s FROM w WHERE len(w) > 0),
e AS (SELECT docweb_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT x.docweb_id AS docweb_id_a, y.docweb_id AS docweb_id_b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common FROM e x JOIN e y ON x.g = y.g AND x.docweb_id < y.docweb_id GROUP BY ALL)"""

_RUNS = r"""
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest([hash(array_to_string(w[k:k + 11], ' ')) for k in range(1, len(w) - 10)]) AS g FROM d WHERE len(w) >= 12),
ig AS (SELECT item_id, unnest([hash(array_to_string(w[k:k + 11], ' ')) for k in range(1, len(w) - 10)]) AS g FROM i WHERE len(w) >= 12)"""

# white space as in truncation.py
_BLANK = "chr(32) || chr(10) || chr(13) || chr(9) || chr(11) || chr(12) || chr(160) || chr(8232) || chr(8233)"

_ENDS = rf"""
t0 AS (SELECT doc_id, source, rtrim(replace(text, '&nbsp;', ' '), {_BLANK}) AS whole FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
t1 AS (SELECT *, CASE WHEN right(whole, 3) = '...' OR right(whole, 1) IN (']', ')', '…', '\uFFFD') OR regexp_matches(right(whole, 10), '[&<]') THEN regexp_replace(whole, '{truncation.MARK.replace("*+", "*")}', '') ELSE whole END AS kept FROM t0 WHERE whole <> ''),
texts AS (SELECT doc_id, source, rtrim(kept, {_BLANK}) AS t, kept <> whole AS marked FROM t1),
split AS (SELECT doc_id, marked, string_split(t, chr(10)) AS l FROM texts),
lines AS (SELECT doc_id, marked, k = len(l) AS is_last, trim(l[k], {_BLANK}) AS line, CASE WHEN k = len(l) AND marked THEN NULL ELSE (l[k], coalesce(l[k - 1], '')) END AS place FROM split, unnest(range(1, len(l) + 1)) AS u(k)),
words AS (SELECT doc_id, is_last, place, list_concat(['', ''], regexp_split_to_array(regexp_replace(regexp_replace(line, '(?:https?://|www\.)[^\s/]+/', 'www/', 'g'), '[0-9]+', '0', 'g'), '[ \t\r\x0B\f\x{{A0}}\x{{2028}}\x{{2029}}]+')) AS w FROM lines WHERE line <> ''),
classes AS (SELECT *, list_transform(w, lambda x: (instr('{truncation.ENDINGS.replace("'", "''")}', right(x, 1)) >> 2) + CASE WHEN starts_with(x, '0') THEN 8 WHEN x < 'a' THEN 16 ELSE 0 END) AS c FROM words),
occ AS (SELECT doc_id, is_last AND k = len(w) AS final, CASE WHEN k = len(w) THEN place END AS place, k < len(w) AS inside, CASE WHEN k = 6 THEN 8 + c[3] % 8 ELSE 0 END AS near, array_to_string(w[k - 2:k], ' ') || ' ' || near AS tri, array_to_string(c[k - 2:k], ' ') || ' ' || near AS shape, c[k] AS class FROM classes, unnest(range(3, len(w) + 1)) AS u(k)),
counted AS (SELECT tri, shape, class, count(*) FILTER (inside) AS inside, count(DISTINCT place) AS ends FROM occ WHERE inside OR place IS NOT NULL GROUP BY ALL),
every AS (SELECT sum(ends) / sum(inside + ends) AS mean, greatest({truncation.LEAST_PRIOR}, {truncation.PRIOR} * (SELECT count(*) FROM texts))::DOUBLE AS prior FROM counted),
shapes AS (SELECT shape, class, sum(inside) AS i, sum(ends) AS e FROM counted WHERE inside > 0 OR ends = 1 GROUP BY ALL),
kinds AS (SELECT class, sum(i) AS i, sum(e) AS e FROM shapes GROUP BY class),
finals AS (SELECT doc_id, tri, shape, class FROM occ WHERE final),
rated AS (SELECT x.doc_id, x.source, x.marked, f.tri, coalesce(n.inside, 0) AS inside, greatest(0, coalesce(n.ends, 0) - CASE WHEN x.marked THEN 0 ELSE 1 END) AS ends, mean, prior, (coalesce(h.e, 0) + prior * (coalesce(g.e, 0) + prior * mean) / (coalesce(g.i + g.e, 0) + prior)) / (coalesce(h.i + h.e, 0) + prior) AS usual
  FROM texts x CROSS JOIN every LEFT JOIN finals f ON f.doc_id = x.doc_id LEFT JOIN counted n ON n.tri = f.tri LEFT JOIN shapes h ON h.shape = f.shape LEFT JOIN kinds g ON g.class = f.class),
judged AS (SELECT doc_id, source, CASE WHEN tri IS NOT NULL AND (ends + prior * usual) / (inside + ends + prior) < {truncation.SELDOM} * mean THEN CASE WHEN inside > 0 THEN 'sentence' ELSE 'word' END WHEN marked THEN 'mark' ELSE 'whole' END AS verdict FROM rated)"""

SQL = {
    "p2_found": f"WITH {_TERMS} SELECT chunk_id, term FROM tfs JOIN dfs USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 8",
    "p2_term_scores": f"""WITH {_TERMS}, n AS (SELECT count(*) AS n FROM one), len AS (SELECT chunk_id, sum(tf) AS dl FROM tfs GROUP BY chunk_id), av AS (SELECT (SELECT sum(dl) FROM len) / (SELECT n FROM n) AS avgdl)
      SELECT chunk_id, term, tf, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM tfs JOIN dfs USING (term) JOIN len USING (chunk_id), n, av""",
    "p3_found": f"WITH {_KINDS} SELECT query_id, chunk_id FROM r WHERE closeness IS NOT NULL AND lexical IS NOT NULL AND weight IS NOT NULL AND c <= 10 AND l <= 10 AND w <= 10",
    "p3_ranking": f"WITH {_FUSED} SELECT s.query_id, s.chunk_id, round(closeness, 6) AS closeness, lexical, weight, round(fused, 6) AS fused, row_number() OVER (PARTITION BY s.query_id ORDER BY fused DESC NULLS LAST, s.chunk_id) AS position FROM s LEFT JOIN fused USING (query_id, chunk_id)",
    "p4_found": f"WITH {_LINES} SELECT DISTINCT docweb_id, line_no FROM keyed JOIN often USING (site, key)",
    "p4_clean_bodies": f"""WITH {_LINES}, kept AS (SELECT keyed.docweb_id, body, line_no, string_split(body, chr(10))[line_no] AS line, often.key IS NULL AS stays FROM keyed JOIN d USING (docweb_id, site) LEFT JOIN often USING (site, key))
      SELECT DISTINCT d.docweb_id, CASE WHEN body IS NOT NULL THEN coalesce(c, '') END AS clean_body FROM d LEFT JOIN (SELECT docweb_id, body, array_to_string(list(line ORDER BY line_no) FILTER (stays), chr(10)) AS c FROM kept GROUP BY ALL) USING (docweb_id, body)""",
    "p5_found": """WITH one AS (SELECT chunk_id, max(embedding) AS v FROM chunks WHERE chunk_id IS NOT NULL AND len(embedding) = 64 GROUP BY chunk_id),
      u AS (SELECT chunk_id, v::DOUBLE[] AS v, sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[])) AS n FROM one)
      SELECT x.chunk_id AS chunk_id_a, y.chunk_id AS chunk_id_b FROM u x JOIN u y ON x.chunk_id < y.chunk_id WHERE x.n > 0 AND y.n > 0 AND list_inner_product(x.v, y.v) / x.n / y.n >= 0.95""",
    "p6_found": """WITH RECURSIVE e AS (SELECT DISTINCT docweb_id AS a, similar_docweb_id AS b FROM duplicates WHERE docweb_id IS NOT NULL AND similar_docweb_id IS NOT NULL),
      both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS docweb_id, a AS m FROM both_ways UNION SELECT r.docweb_id, w.b FROM reach r JOIN both_ways w ON r.m = w.a)
      SELECT docweb_id, min(m) AS group_id FROM reach GROUP BY docweb_id""",
    "p7_found": f"WITH {_SHINGLES} SELECT docweb_id_a, docweb_id_b FROM c WHERE common >= 0.7 * (na + nb - common) - 1e-9",
    "p10_found": f"WITH {_ENDS} SELECT DISTINCT doc_id FROM judged WHERE verdict <> 'whole'",
    "p10_by_source": f"""WITH {_ENDS} SELECT nullif(lower(trim(source)), '') AS source, count(*) AS texts, count(*) FILTER (verdict <> 'whole') AS cut, count(*) FILTER (verdict <> 'whole') / count(*) AS share,
      count(*) FILTER (verdict = 'word') AS words, count(*) FILTER (verdict = 'sentence') AS sentences, count(*) FILTER (verdict = 'mark') AS marks FROM judged GROUP BY 1""",
    "p8_found": f"WITH {_RUNS} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
}
