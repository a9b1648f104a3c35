"""How distinctive a term is for a record: BM25 weights of every term of every record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import materialise, skew_join


def _postings(batches):
    import re
    import unicodedata
    from collections import Counter

    import pyarrow as pa

    runs = re.compile(r"[^\W\d_]+")
    for b in batches:
        ids, terms, tfs, dls = [], [], [], []
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text or "").lower())
            words = runs.findall(text)
            if any(not w.isalpha() for w in words):  # numerals that \w holds but that are no letters
                words = [x for w in words for x in "".join(c if c.isalpha() else " " for c in w).split()]
            n = Counter(words)
            ids += [k] * (len(n) + 1)
            terms += [None, *n]
            tfs += [0, *n.values()]
            dls += [len(words)] * (len(n) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(terms, pa.string()), pa.array(tfs, pa.int32()), pa.array(dls, pa.int32())], names=["id", "term", "tf", "dl"])


def term_scores(records: DataFrame, id_col: str, text_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, term, tf, df, score): probabilistic relevance weight of each term of each record.

    score = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), with N records, df of them
    holding the term, dl words in the record and avgdl on average. Terms are maximal runs of letters of the text after
    composing accents (NFC) and lower-casing.

    Texts are tokenised once, in Arrow batches, to (record, term, count) rows, which are written to the shared folder;
    document frequencies are combined before their shuffle. Terms held by more than a thousandth of the postings get
    their frequency by a broadcast of at most a thousand rows, all others by a shuffle join, so that no common word
    lands in one task.

    Records with a null id are left out. Rows that repeat an id count once, by their greatest text. Null and empty texts
    are records without terms: they count in N and avgdl and give no rows. An empty table gives an empty result."""
    one = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").groupBy("id").agg(F.max("text").alias("text"))
    id_type = dict(one.dtypes)["id"]
    post = materialise(one.mapInArrow(_postings, f"id {id_type}, term string, tf int, dl int"), "postings")
    n, avgdl, total = post.agg(F.count_if(F.col("term").isNull()), F.avg(F.when(F.col("term").isNull(), F.col("dl"))), F.count("term")).first()
    terms = post.where("term is not null")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    found = skew_join(terms, df, ["term"], "df", total)
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl or 1) or 1.0)))
    return found.select("id", "term", "tf", "df", (idf * part).alias("score"))
