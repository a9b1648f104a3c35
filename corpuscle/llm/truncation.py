"""Text cut off by field limits: word trigrams inside lines against those at their ends, in SQL only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from corpuscle.session import HOT_SHARE, materialise

#: What the shape of a trigram counts for, in occurrences: a share of the number of texts, and at least so many.
PRIOR, LEAST_PRIOR = 0.01, 3
#: A text was cut if its final trigram ends lines more seldom than this part of the mean over all trigrams.
SELDOM = 1.0

# White space at the ends of texts and lines, and marks that programs leave where they cut (dots, an
# ellipsis, either in brackets, halves of a character, of an entity or of a tag).
BLANK = " \\n\\r\\t\\u000b\\f\\u00a0\\u2028\\u2029"
BLANKS = "' ', '\\n', '\\r', '\\t', '\\u000b', '\\f', '\\u00a0', '\\u2028', '\\u2029'"
MARK = r"(?:\s*+(?:\.\.\.+|…|\[\s*+(?:\.\.\.|…)\s*+\]|\(\s*+(?:\.\.\.|…)\s*+\)|\x{FFFD}+|&#?[A-Za-z0-9]{0,8}|</?[A-Za-z]{0,8}))+$"

# The class of a word, 0 to 31: by its last character, of which four in a row here are alike (the first three are none), and
# by whether it begins with a digit, or else with a capital or a sign.
ENDINGS = "   .!?.,,,,;:;:0000)]))»”\"»’'’'"
_CLASS = "(shiftright(instr('{endings}', right({x}, 1)), 2) | IF(startswith({x}, '0'), 8, IF({x} < 'a', 16, 0)))"

# Words of a line, after two empty ones for its beginning. Numbers become 0 and addresses lose their host; only lines with an
# address pay for that pattern.
_WORDS = r"""concat(array('', ''), split(regexp_replace(
    CASE WHEN contains(line, 'www.') OR contains(line, '://') THEN regexp_replace(line, r"(?:https?://|www\.)[^\s/]+/", 'www/') ELSE line END,
    '[0-9]+', '0'), r"[ \t\r\x0B\f\x{A0}\x{2028}\x{2029}]+"))"""

# The trigram at word i of w as a hash whose last 19 bits are its shape: the classes of its words, and, where it is made of
# the second to fourth word of a line, the ending of the first (places stand before dates at the end of a text).
_NEAR = f"IF({{i}} = 5, 8 + ({_CLASS.replace('{x}', 'w[2]')} & 7), 0)"
_TRIGRAM = f"(xxhash64(w[{{i}} - 2], w[{{i}} - 1], w[{{i}}], {_NEAR}) & -524288L) | CAST(shiftleft({_CLASS.replace('{x}', 'w[{i} - 2]')}, 14) | shiftleft({_CLASS.replace('{x}', 'w[{i} - 1]')}, 9) | shiftleft({_NEAR}, 5) | {_CLASS.replace('{x}', 'w[{i}]')} AS BIGINT)"

# A projection is computed anew for each use of its columns; what a generator gives is computed once. That is why texts, lines
# and words come out of an explode of one element. Trimming a set of characters is slow, so only what ends in one is trimmed.
_TEXTS = r"""texts AS (
  SELECT id, source, marked, IF(marked AND right(kept, 1) IN ({blanks}), trim(TRAILING '{blank}' FROM kept), kept) AS t
  FROM (
    SELECT id, source, kept, length(kept) < length(whole) AS marked FROM (SELECT `{id}` AS id, `{source}` AS source, replace(`{text}`, '&nbsp;', ' ') AS text FROM {docs} WHERE `{id}` IS NOT NULL AND `{text}` IS NOT NULL)
      LATERAL VIEW explode(array(right(text, 10))) AS first_tip
      LATERAL VIEW explode(array(IF(right(first_tip, 1) IN ({blanks}), trim(TRAILING '{blank}' FROM text), text))) AS whole
      LATERAL VIEW explode(array(IF(right(first_tip, 1) IN ({blanks}), right(whole, 10), first_tip))) AS tip
      LATERAL VIEW explode(array(IF(right(tip, 3) = '...' OR right(tip, 1) IN (']', ')', '…', '�') OR contains(tip, '&') OR contains(tip, '<'), regexp_replace(whole, r"{mark}", ''), whole))) AS kept
    WHERE whole <> ''))"""
_LINE = "explode(array(IF(left({line}, 1) IN ({blanks}) OR right({line}, 1) IN ({blanks}), trim(BOTH '{blank}' FROM {line}), {line}))) AS line"

#: One row a text: its final trigram, null if nothing but a mark is there.
_FINALS = """WITH {texts}
SELECT id, source, marked, IF(t <> '', {trigram at size(w) - 1}, NULL) AS tri
FROM texts LATERAL VIEW explode(array(substring_index(t, '\\n', -1))) AS tail LATERAL VIEW {trimmed tail} LATERAL VIEW explode(array({words})) AS w"""

#: Occurrences of each trigram inside lines, and at ends of lines.
_COUNTED = """WITH {texts}, lines AS (
  SELECT line, IF(x.no = 0 AND marked, NULL, xxhash64(x.line, x.before) | 1L) AS place
  FROM texts LATERAL VIEW explode(array(reverse(split(t, '\\n')))) AS ls
    LATERAL VIEW explode(zip_with(transform(ls, (l, k) -> struct(l, k)), slice(ls, 2, size(ls)), (a, b) -> struct(a.l AS line, a.k AS no, b AS before))) AS x
    LATERAL VIEW {trimmed x.line}
), worded AS (
  SELECT w, size(w) AS n, place FROM lines LATERAL VIEW explode(array({words})) AS w WHERE line <> ''
), occurrences AS (
  SELECT {trigram at i} AS tri, IF(i = n - 1, place, 0L) AS place FROM worded LATERAL VIEW explode(sequence(2, n - 1)) AS i
)
SELECT tri, sum(IF(place = 0, n, 0L)) AS inside, count_if(place <> 0) AS ends
FROM (SELECT tri, place, count(*) AS n FROM occurrences WHERE place IS NOT NULL GROUP BY tri, place) GROUP BY tri"""

# Shapes are at most 524,288 rows of three numbers, final trigrams of more than a thousandth of all texts at most a thousand.
_JUDGED = """WITH size AS (SELECT count(*) AS texts FROM {finals}),
every AS (SELECT coalesce(sum(ends) / sum(inside + ends), 0D) AS mean, greatest({least_prior}, {prior} * (SELECT texts FROM size)) AS prior FROM {counts}),
shapes AS (SELECT tri & 524287L AS shape, sum(inside) AS inside, sum(ends) AS ends FROM {counts} WHERE inside > 0 OR ends = 1 GROUP BY 1),
classes AS (SELECT shape & 31L AS class, sum(inside) AS inside, sum(ends) AS ends FROM shapes GROUP BY 1),
hot AS (SELECT tri FROM {finals} GROUP BY tri HAVING count(*) > greatest(1, {hot} * (SELECT texts FROM size))),
stats AS (SELECT tri AS key, inside, ends FROM {counts} LEFT SEMI JOIN (SELECT DISTINCT tri AS own FROM {finals}) ON tri = own),
hot_stats AS (SELECT hot.tri AS key, s.inside, s.ends FROM hot LEFT JOIN stats s ON s.key = hot.tri),
known AS (
  SELECT /*+ BROADCAST(s) */ f.*, s.inside, s.ends FROM {finals} f JOIN hot_stats s ON f.tri = s.key
  UNION ALL
  SELECT f.*, s.inside, s.ends FROM (SELECT /*+ BROADCAST(hot) */ f.* FROM {finals} f LEFT ANTI JOIN hot ON f.tri = hot.tri WHERE f.tri IS NOT NULL) f LEFT JOIN stats s ON f.tri = s.key
  UNION ALL
  SELECT f.*, 0L, 0L FROM {finals} f WHERE f.tri IS NULL
), rated AS (
  SELECT /*+ BROADCAST(h), BROADCAST(c), BROADCAST(e) */ k.id, k.source, k.marked, coalesce(k.inside, 0L) AS inside, greatest(0L, coalesce(k.ends, 0L) - IF(k.marked, 0, 1)) AS ends, k.tri, e.mean, e.prior,
    (coalesce(h.ends, 0L) + e.prior * (coalesce(c.ends, 0L) + e.prior * e.mean) / (coalesce(c.inside + c.ends, 0L) + e.prior)) / (coalesce(h.inside + h.ends, 0L) + e.prior) AS usual
  FROM known k CROSS JOIN every e LEFT JOIN shapes h ON (k.tri & 524287L) = h.shape LEFT JOIN classes c ON (k.tri & 31L) = c.class
), judged AS (
  SELECT id, source, inside, ends, CASE
      WHEN tri IS NOT NULL AND (ends + prior * usual) / (inside + ends + prior) < {seldom} * mean THEN IF(inside > 0, 'sentence', 'word')
      WHEN marked THEN 'mark' ELSE 'whole' END AS verdict
  FROM rated
)
"""


def _judge(docs: DataFrame, id_col: str, text_col: str, source_col: str, query: str) -> DataFrame:
    spark, tag = docs.sparkSession, uuid.uuid4().hex
    names = {k: f"{k}_{tag}" for k in ("docs", "finals", "counts")}
    names |= {"id": id_col, "text": text_col, "source": source_col, "blank": BLANK, "blanks": BLANKS, "mark": MARK, "endings": ENDINGS.replace("'", "\\'"), "hot": f"{1 / HOT_SHARE}D", "prior": f"{PRIOR}D", "least_prior": f"{LEAST_PRIOR}D", "seldom": f"{SELDOM}D"}

    def filled(sql: str) -> str:
        sql = sql.replace("{texts}", _TEXTS).replace("{words}", _WORDS)
        for line in ("tail", "x.line"):
            sql = sql.replace("{trimmed " + line + "}", _LINE.replace("{line}", line))
        for i in ("i", "size(w) - 1"):
            sql = sql.replace("{trigram at " + i + "}", _TRIGRAM.replace("{i}", f"({i})"))
        for k, v in names.items():
            sql = sql.replace("{" + k + "}", str(v))
        return sql

    docs.createOrReplaceTempView(names["docs"])
    materialise(spark.sql(filled(_FINALS)), "finals").createOrReplaceTempView(names["finals"])
    materialise(spark.sql(filled(_COUNTED)), "trigrams").createOrReplaceTempView(names["counts"])
    return spark.sql(filled(_JUDGED + query))


def truncated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, inside, ends, verdict): the texts that were cut off, and how that shows.

    Words are runs without white space, so they carry their punctuation; numbers count as 0, and addresses without their host.
    All trigrams of all lines are counted, those inside lines and, apart from them, those at ends of lines (the beginning of
    a line fills up its first two); copies, that is lines that repeat together with the line before, end once. A text was
    cut if its final trigram is frequent inside but almost never terminal: if of its occurrences a smaller part than SELDOM
    of the mean over all trigrams is at other ends. Rare trigrams say little by themselves, so each is joined by as many
    occurrences as PRIOR of the number of texts, with the share of ends usual for its shape (the classes of its words,
    told by their first and last characters; rare shapes lean on the class of the last word), closing lines left aside. Every bound is thus relative to the corpus.

    `inside` and `ends` are the counts of the final trigram, `ends` without the text itself. Verdicts: 'sentence' - cut, and the
    trigram is known from inside; 'word' - cut, and it stands nowhere inside, so the last word is mostly a part; 'mark' - not so
    judged, but a mark of a cut follows, such as an ellipsis (all others are judged by what stands before the mark).

    Null, empty and blank texts, and rows with a null id, give no row. Texts of one or two words are judged likewise. A row
    repeated is a result repeated. An empty table gives an empty result."""
    return _judge(docs, id_col, text_col, source_col, f"SELECT id AS `{id_col}`, source AS `{source_col}`, inside, ends, verdict FROM judged WHERE verdict <> 'whole'")


def truncation_by_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, texts, cut, share, words, sentences, marks): how often each source cuts off its texts; see truncated().

    Sources are the same without regard to letter case and blanks around them; records without source are one row (null)."""
    query = f"""SELECT nullif(lower(trim(source)), '') AS `{source_col}`, count(*) AS texts, count_if(verdict <> 'whole') AS cut, count_if(verdict <> 'whole') / count(*) AS share,
      count_if(verdict = 'word') AS words, count_if(verdict = 'sentence') AS sentences, count_if(verdict = 'mark') AS marks FROM judged GROUP BY 1"""
    return _judge(docs, id_col, text_col, source_col, query)
