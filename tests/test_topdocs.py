"""search() against the scores of all pairs, with nothing in its plan that has a row for each pair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import columns as C
from corpuscle.operators import search
from corpuscle.plans.catalogue import QUERIES

ROLES = {"sintesi": 1, "fatti": 1, "motivazione": 2, "dispositivo": 2}


@pytest.fixture(scope="module")
def odd(spark):
    """Equal scores, null and repeated ids, null, zero, short and broken vectors, null and negative weights, documents of many chunks."""
    rnd = random.Random(5)
    words = ["gatto", "cane", "topo", "pesce", "corvo"]
    rows = []
    for i in range(150):
        v = rnd.choice([None, [0.0] * 3, [1.0, 2.0]] + [[float(rnd.randrange(3)) for _ in range(3)]] * 9)
        text = rnd.choice([None, ""] + [" ".join(rnd.choices(words, k=4))] * 9)
        rows.append((f"{i}_0", rnd.choice([None, 1, 1, 1, i % 30]), rnd.choice([*ROLES, None, "altro"]), rnd.choice([None, 0.5, 1.0, -1.0]), ["Parere"], rnd.choice([None, "2020-01-01", "1999"]), text, v))
    c = spark.createDataFrame(rows + rows[:9], "chunk_id string, docweb_id long, section string, weight double, tipologia array<string>, date string, embed_text string, embedding array<double>")
    asked = [(1, "gatto cane", [1.0, 0.0, 1.0]), (2, "", [0.0, 2.0, 1.0]), (3, "topo 12", [1.0, 1.0, 1.0]), (4, "pesce", None), (5, None, [0.0, 0.0, 1.0]), (6, "corvo", [0.0, 0.0, 0.0])]
    return c, spark.createDataFrame(asked, "query_id long, query string, embedding array<double>")


def by_pairs(c, q, alpha, k, years=None):
    """What search() should give, from the scores of all pairs."""
    info = {r.chunk_id: r for r in search.distinct_chunks(c).withColumn("y", C.year(F.col("date"))).collect()}
    docs = {}
    for r in search.hybrid_scores(c, q, alpha, stemmed=False).collect():
        x = info[r.chunk_id]
        if years is None or years[0] <= x.y <= years[1]:
            d = docs.setdefault(r.query_id, {}).setdefault(x.docweb_id, {})
            for role in {0, ROLES.get(x.section, 0)}:
                d.setdefault(role, []).append((-r.score, r.chunk_id))
    out = []
    for i, found in docs.items():
        best = sorted(([min(d[n]) if n in d else (None, None) for n in range(3)], doc) for doc, d in ((str(x), y) for x, y in found.items()))[:k]
        out += [(i, n + 1, doc, *(y for s, cid in b for y in (None if s is None else round(-s, 9), cid))) for n, (b, doc) in enumerate(best)]
    return sorted(out, key=repr)


def given(df):
    near = lambda s: None if s is None else round(s, 9)
    return sorted(((r.query_id, r["rank"], str(r.docweb_id), near(r.score), r.chunk_id, near(r.activity_score), r.activity_chunk, near(r.violation_score), r.violation_chunk) for r in df.collect()), key=repr)


def matches(monkeypatch, odd, alpha):
    """One query a block and nothing held, or all; all documents kept or few; no window, and no join on chunks, in the plan."""
    c, q = odd
    for cells, k, years in ((1, 3, None), (10**7, 3, (1990, 2000)), (10**7, 100, None)):
        monkeypatch.setattr("corpuscle.operators.topdocs.CELLS", cells)
        monkeypatch.setattr("corpuscle.operators.topdocs.HELD", cells)
        df = search.search(c, q, k=k, alpha=alpha, years=years, stemmed=False)
        assert given(df) == by_pairs(c, q, alpha, k, years)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Window" not in plan and not re.search("Join.*chunk_id", plan)


def test_by_vectors_only(monkeypatch, odd):
    matches(monkeypatch, odd, 0.0)


def test_by_keywords_only(monkeypatch, odd):
    matches(monkeypatch, odd, 1.0)


def test_fused(monkeypatch, odd):
    matches(monkeypatch, odd, 0.3)


def test_a_mask_that_nothing_passes(odd):
    assert search.search(*odd, years=(1900, 1901)).count() == 0 and search.search(*odd, types=["Altro"]).count() == 0
    one = search.search(*odd, scope="activity", k=100, stemmed=False)
    assert one.count() and one.where("activity_chunk <> chunk_id or violation_chunk is not null").count() == 0


def test_vectors_of_several_lengths(spark, odd):
    """Models of different lengths in one table: a query meets the chunks of its own length."""
    q = spark.createDataFrame([(1, "a", [1.0, 0.0, 1.0]), (2, "b", [1.0, 0.0])], "query_id long, query string, embedding array<double>")
    got = search.search(odd[0], q, k=100, alpha=0.0)
    short = {r.chunk_id for r in odd[0].where("size(embedding) = 2").collect()}
    assert {r.chunk_id in short for r in got.where("query_id = 2").collect()} == {True} and {r.chunk_id in short for r in got.where("query_id = 1").collect()} == {False}


@pytest.mark.parametrize("name", ["hybrid_search", "search_masked", "search_stemmed", "retrieval_evaluation", "retrieval_summary"])
def test_no_row_for_each_pair(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["retrieval_evaluation", "retrieval_summary"])
def test_results_are_not_broadcast(spark, name):
    """Spark takes results for as large as the queries, though each query has k of them; they must not go through the driver."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[chunk_id", plan) and not re.search(r"BroadcastHashJoin \[chunk_id", plan)
