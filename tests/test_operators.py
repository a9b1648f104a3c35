import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import columns as C
from corpuscle.operators import analysis, documents, export, search, state
from corpuscle.operators.components import connected_components
from corpuscle.sources import tables
from corpuscle.streaming.upsert import current, upsert_stream

CH = "chunk_id string, docweb_id long, section string, tipologia array<string>, argomenti array<string>, date string, weight double, embed_text string, embedding array<float>"


def chunks(spark):
    rows = [("1_000", 1, "fatti", ["Provvedimenti"], ["A"], "2020-01-01", 1.0, "gatto nero gatto", [1.0, 0.0]), ("1_001", 1, "motivazione", ["Provvedimenti"], ["A"], "2020-01-01", 0.9, "cane bianco", [0.6, 0.8]), ("2_000", 2, "testo", ["Parere"], ["B"], None, None, "gatto bianco molto bianco", [0.0, 2.0]), ("3_000", 3, "testo", None, None, None, 1.0, None, None), ("4_000", 4, "testo", [], [], "x", 1.0, "", [0.0, 0.0])]
    return spark.createDataFrame([*rows, rows[0]], CH)


def queries(spark):
    return spark.createDataFrame([(1, "gatto", ["A"], "it", [1.0, 0.0]), (2, "", ["Z"], "en", [0.0, 1.0]), (3, "art. 5 «cane»", ["B"], "it", None)], "query_id long, query string, tags array<string>, lang string, embedding array<float>")


def test_bm25_by_hand(spark):
    w = {(r.chunk_id, r.term): r.weight for r in search.bm25_postings(search.distinct_chunks(chunks(spark))).collect()}
    n, mean = 5, (3 + 2 + 4) / 5
    idf = math.log1p((n - 2 + 0.5) / (2 + 0.5))
    assert w["1_000", "gatto"] == pytest.approx(2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)) * idf)
    assert ("3_000", "gatto") not in w
    s = search.bm25_scores(search.bm25_postings(search.distinct_chunks(chunks(spark))), queries(spark))
    assert {(r.query_id, r.chunk_id) for r in s.collect()} == {(1, "1_000"), (1, "2_000"), (3, "1_001")}


def test_fusion_edges(spark):
    one = lambda a, **k: {(r.query_id, r.chunk_id): r.score for r in search.hybrid_scores(chunks(spark), queries(spark), a, **k).collect()}
    assert one(0.0)[1, "1_001"] == pytest.approx(0.54) and one(-1.0, weighted=False)[1, "1_001"] == pytest.approx(0.6)
    assert one(1.0)[1, "1_001"] == 0.0 and one(2.0)[1, "1_000"] > 0
    half = one(0.3)
    assert half[1, "1_000"] == pytest.approx(0.7 / 60 + 0.3 / 60) and half[1, "1_001"] == pytest.approx(0.7 / 61)
    assert half[2, "2_000"] == pytest.approx(0.7 / 60)  # an empty query has no keyword part
    assert [r.a for r in queries(spark).select(C.effective_alpha(F.col("query"), 0.3).alias("a")).collect()] == [0.3, 0.3, 0.6]
    assert queries(spark).select(C.effective_alpha(F.col("query"), 0.0).alias("a")).distinct().count() == 1


def test_search_and_evaluation(spark):
    res = search.search(chunks(spark), queries(spark), k=1)
    r = {x.query_id: x for x in res.collect()}
    assert r[1].docweb_id == 1 and r[1].activity_chunk == "1_000" and r[1].violation_chunk == "1_001" and r[2].violation_chunk is None
    assert search.search(chunks(spark), queries(spark), scope="violation").select("docweb_id").distinct().collect() == [(1,)]
    assert search.search(chunks(spark), queries(spark), years=(0, 10)).select("docweb_id").distinct().collect() == [(2,)]
    ev = {x.query_id: x for x in search.evaluate(res, chunks(spark), queries(spark)).collect()}
    assert ev[1].precision == 0.1 and ev[1].rr == 1.0 and ev[3].rr == 0.0
    s = {x.lang: x for x in search.evaluation_summary(search.evaluate(res, chunks(spark), queries(spark))).collect()}
    assert s["all"].queries == 3 and s["it"].mrr == 0.5
    assert search.search(chunks(spark).limit(0), queries(spark)).count() == 0 and search.search(chunks(spark), queries(spark).limit(0)).count() == 0


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 470)] + [(None, 3), (5, 5)]
    parent = {i: i for i in range(500)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    for one_task in (200_000, 10):
        got = connected_components(spark.range(500), spark.createDataFrame(edges, "src long, dst long"), one_task=one_task).collect()
        assert len(got) == 500 and all(r.component == find(r.id) for r in got)
    assert connected_components(spark.range(2), spark.createDataFrame([], "src long, dst long")).count() == 2


DOC = "docweb_id long, url string, title string, date string, tipologia array<string>, argomenti array<string>, body string, body_chars int, body_sha256 string"


def docs(spark, rows):
    return spark.createDataFrame([(i, "u", "t", d, ["P"], a, b, None if b is None else len(b), h) for i, d, b, h, a in rows], DOC)


LONG = "Il titolare ha trattato i dati senza il consenso degli interessati e non ha risposto. " * 5


def test_selection(spark):
    english = "The data of the person is processed by the controller with the consent of this person. " * 12
    rows = [(1, "2020-01-01", LONG, "a", []), (2, "2021-01-01", LONG, "a", []), (3, None, LONG, "b", []), (4, "2022-01-01", "breve", "c", []), (5, "2022-01-02", LONG + "\nRedirect", "d", []), (6, "2023-01-01", english, "e", []), (7, "2023-01-02", english, "e", []), (8, "2019-01-01", None, None, [])]
    got = {r.docweb_id: r.verdict for r in documents.select_documents(docs(spark, rows)).collect()}
    assert got == {1: "duplicate_body", 2: "keep", 3: "keep", 4: "short_or_empty", 5: "redirect_stub", 6: "english", 7: "english", 8: "short_or_empty"}
    assert {r.docweb_id for r in documents.select_documents(docs(spark, rows), 1).collect()} == {2, 4, 5, 6, 7}
    assert documents.select_documents(docs(spark, rows), 5).count() == 8 and documents.select_documents(docs(spark, []), 5).count() == 0


def test_links_beside_the_smallest_id_of_a_bucket(spark):
    one_bucket = lambda one: one.select("id", "n", F.lit(0).alias("band"), F.lit(0).cast("long").alias("key"))
    same = [f"parola{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = [(1, " ".join(f"altra{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))), (2, " ".join(same)), (3, " ".join(same[:-1] + ["diversa"]))]
    d = spark.createDataFrame([(i, t, f"2020-01-0{i}") for i, t in rows], "docweb_id long, body string, date string")
    assert {r.docweb_id: r.representative for r in documents.families(d, band_rows=one_bucket).collect()} == {1: 1, 2: 3, 3: 3}


def test_families_and_index(spark):
    words = lambda s, n=120: " ".join("".join(random.Random(s * 1000 + i).choices("abcdefgh", k=7)) for i in range(n))
    base = words(1)
    rows = [(1, "2020-01-01", base, "a", ["A"]), (2, "2021-01-01", base + " coda breve", "b", ["A"]), (3, "2019-01-01", "inizio " + base, "c", []), (4, "2020-01-01", words(2), "d", ["B"]), (5, None, base, "a2", []), (6, None, "", "e", [])]
    d = docs(spark, rows)
    got = {r.docweb_id: r.representative for r in documents.families(d).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 5: 2, 4: 4, 6: 6}
    assert {r.similar_docweb_id for r in documents.family_map(d, documents.families(d)).collect()} == {1, 3, 5}
    out, twins, figures = documents.build_index(d)
    ids = {(r.chunk_id, r.similar_count) for r in out.collect()}
    assert ids == {("2_000", 3), ("4_000", 0)} and figures.first().template_families == 1 and figures.first().largest_families[0] == 4
    assert out.columns == [f.split()[0] for f in tables.CHUNKS_SCHEMA.replace("map<string,double>", "m").split(", ")]
    assert documents.build_index(docs(spark, []))[0].count() == 0


def test_mining(spark):
    p = "VISTO il regolamento europeo in materia di protezione dei dati personali del cittadino"
    rows = [(i, None, f"{p} {i}.\nIl caso {chr(97 + i)} riguarda una persona; la sanzione va annotata nel registro interno previsto dalla norma.", str(i), [f"T{i % 3}"]) for i in range(6)]
    d = docs(spark, rows)
    cut = documents.outlines(d)
    found = documents.boilerplate_keys(cut, 5)
    assert {r.key: r.docs for r in found.collect()} == {p.lower() + " 0.": 6}
    boiler = documents.boilerplate(cut, found)
    said = documents.sentence_phrases(cut, boiler)
    ph = documents.procedural_phrases(documents.hashed(said), 5, 3, 0.5)
    texts = {r.phrase: r for r in documents.phrase_texts(said, ph).collect()}
    assert "annotata nel registro interno previsto" in texts and texts["annotata nel registro interno previsto"].top_tag == 2
    formula = documents.formulas(documents.hashed(said), ph)
    assert {(r.docweb_id, r.sentence_no) for r in formula.collect()} == {(i, 0) for i in range(6)}
    made = documents.chunk(cut, boiler, said.where("docweb_id = 3 and sentence_no = 0").select("docweb_id", "para_no", "sentence_no"))
    got = {r.docweb_id: r.text for r in made.collect()}
    assert 3 not in got and all("VISTO" not in t and "annotata" in t for t in got.values()) and len(got) == 5
    alone = documents.outlines(docs(spark, [(1, None, LONG, "a", [])]))
    said = documents.hashed(documents.sentence_phrases(alone, documents.boilerplate(alone, documents.boilerplate_keys(alone))))
    assert documents.procedural_phrases(said, 1, 1).count() == 0


def test_formulas_are_mostly_procedural_phrases(spark):
    same = "la sanzione va annotata nel registro interno previsto dalla norma vigente"
    rows = [(i, None, f"Il caso {chr(97 + i)} riguarda la persona numero{chr(97 + i)}. Inoltre {same}. Per la violazione degli artt. 5 e 13 {same}.", str(i), [f"T{i % 3}"]) for i in range(6)]
    cut = documents.outlines(docs(spark, rows))
    said = documents.hashed(documents.sentence_phrases(cut, documents.boilerplate(cut, documents.boilerplate_keys(cut, 99))))
    formula = documents.formulas(said, documents.procedural_phrases(said, 5, 3, 0.5))
    assert sorted((r.docweb_id, r.sentence_no) for r in formula.collect()) == [(i, 1) for i in range(6)]  # violations are kept
    assert documents.dropped_words(formula).first().words == 6 * 12


def test_state(spark, tmp_path):
    import datetime as dt

    t = [dt.datetime(2024, 1, i) for i in range(1, 9)]
    st = spark.createDataFrame([(1, "a", None, None, None, None, t[0], 200, t[1], "h"), (2, "b", None, None, None, None, t[0], None, None, None)], state.STATE_SCHEMA)
    items = spark.createDataFrame([(1, "neu", "d", "[]", "[]", "x"), (3, "c", "d", "[]", "[]", "x"), (None, "n", "d", "[]", "[]", "x")], "docweb_id long, title string, list_date string, tipologia string, argomenti string, listing_text string")
    got = {r.docweb_id: r for r in state.upsert_listing(st, items, t[5]).collect()}
    assert set(got) == {1, 2, 3} and got[1].title == "neu" and got[1].first_seen == t[0] and got[1].raw_sha256 == "h" and got[3].first_seen == t[5] and got[2].title == "b"
    assert {r.docweb_id for r in state.work_queue(state.upsert_listing(st, items, t[5])).collect()} == {2, 3}
    assert state.work_queue(st, 1, True).count() == 1
    f = state.record_fetches(st, spark.createDataFrame([(2, 404, t[2], None), (2, 200, t[3], "z")], "docweb_id long, fetch_status int, fetched_at timestamp, raw_sha256 string"))
    assert {r.docweb_id: r.raw_sha256 for r in f.collect()} == {1: "h", 2: "z"}
    pages = spark.createDataFrame([("ASC", 3, 1, t[0])], state.PAGES_SCHEMA)
    assert state.next_page(pages, "ASC") == 4 and state.next_page(pages, "DESC") == 1
    assert state.replace_by_key(pages, spark.createDataFrame([("ASC", 3, 9, t[1])], state.PAGES_SCHEMA), ["order_dir", "page"]).first().n_items == 9
    assert [r.docweb_id for r in state.unknown_ids(items, st).collect()] == [3]


def test_streamed_upserts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "state", "ck"))
    schema = "docweb_id long, title string, list_date string, tipologia string, argomenti string, listing_text string, seen_at timestamp"
    for batch in ([(1, "a"), (2, "b")], [(2, "bb"), (3, "c")]):
        spark.createDataFrame([(i, t, "d", "[]", "[]", "x", None) for i, t in batch], schema).coalesce(1).write.mode("append").json(src)
        upsert_stream(spark.readStream.schema(schema).json(src), out, ck).awaitTermination()
    assert {r.docweb_id: r.title for r in current(spark, out).collect()} == {1: "a", 2: "bb", 3: "c"}


def test_columns(spark):
    one = spark.createDataFrame([("euro 24.000 (ventiquattromila), euro 20.000,00 (ventimila), EURO 24.000 (x)", "perché un due tre quattro 12 xx", "<b>Perché & privacy</b>\nprivati")], "a string, b string, c string")
    r = one.select(C.fines(F.col("a")).alias("f"), C.highlight(F.col("c"), "la privacy perché").alias("h"), C.passage(F.col("b"), 14).alias("p")).first()
    assert r.f == [20000.0, 24000.0]
    assert r.h == "&lt;b&gt;<mark>Perché</mark> &amp; <mark>privacy</mark>&lt;/b&gt;<br><mark>privati</mark>" and r.p == "perché un due …"
    days = {"03/12/99": "1999-12-03", "01/02/18": "2018-02-01", "31/02/2020": None, "x": None}
    got = spark.createDataFrame([(k,) for k in days], "d string").select("d", C.iso_date(F.col("d")).alias("i")).collect()
    assert {r.d: r.i for r in got} == days


def test_shingles(spark):
    d = spark.createDataFrame([(1, "perché un due tre quattro 12 xx"), (2, "perché un due tre quattro 7 [omissis]"), (3, "uno due"), (4, None), (5, "")], "docweb_id long, body string")
    got = {r.id: sorted(r.s) for r in documents.shingles(d).collect()}
    assert set(got) == {1, 2, 3} and len(got[1]) == 3 and got[1] == got[2] and len(got[3]) == 1


def test_picks_and_auc(spark):
    x = spark.createDataFrame([(i,) for i in range(1, 11)], "x int")
    assert analysis.picks(x, "x", {"a": 0.1, "b": 0.5, "c": 0.9, "d": 1.0}, False).first() == (2, 6, 10, 10)
    assert analysis.picks(x, "x", {"a": 0.1, "b": 0.5, "c": 0.9, "d": 1.0}, True).first() == (1, 5, 9, 10)
    s = lambda *v: spark.createDataFrame([(float(i),) for i in v], "cosine double")
    assert analysis.auc(s(1, 1), s(1, 1)).first().auc == 0.5
    assert analysis.auc(s(0.9, 0.5, 0.2), s(0.5, 0.1)).first().auc == pytest.approx((2 + 1.5 + 1) / 6)


def test_edges(spark):
    d = spark.createDataFrame([(1, [2, 9, 1], None, [3]), (2, [1], [77], []), (5, [1], [], [])], "docweb_id long, cites array<long>, see_also array<long>, refs_in_text array<long>")
    nodes, twins = spark.createDataFrame([(1,), (2,), (3,)], "docweb_id long"), spark.createDataFrame([(3, 9), (8, 77)], "docweb_id long, similar_docweb_id long")
    assert {tuple(r) for r in analysis.citation_edges(d, nodes, twins).collect()} == {(1, 2), (1, 3)}


def test_map_and_ranks_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "docweb_id long, v array<double>")
    xy, var = analysis.pca_2d(v)
    s = np.linalg.svd(x - x.mean(0))[1] ** 2
    assert var.first().var_2d == pytest.approx(s[:2].sum() / s.sum())
    assert np.var([r.x for r in xy.collect()]) == pytest.approx(s[0] / 60, rel=1e-2)
    e = spark.createDataFrame([(0, 1), (5, 9)], "src long, dst long")
    sims = x @ x.T
    for r in analysis.link_ranks(v, e, 1).collect():
        assert r["rank"] == 1 + sum(sims[r.src, k] > sims[r.src, r.dst] for k in range(60) if k != r.src)
    assert analysis.graph_figures(v, e).first().recall10 is not None


def test_sinks(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    c = tables.table(spark, "/root/testdata/sf0.001", "chunks").limit(5)
    export.write_jsonl(c.drop("embedding"), p("c"), "gzip")
    assert tables.read_chunks_jsonl(spark, p("c")).drop("section_shares").exceptAll(c.drop("embedding", "section_shares")).count() == 0
    rows = [(1, 2, "2020", "t", "u"), (1, 3, None, "t", "u"), (4, 5, None, None, None)]
    export.write_families(spark.createDataFrame(rows, "docweb_id long, similar_docweb_id long, date string, title string, url string"), p("f"))
    assert {tuple(r) for r in tables.read_families(spark, p("f")).collect()} == set(rows)
    listing = spark.createDataFrame([("a, b\"c", "d", ["x", "y"], [], "e", "u", "1")], "titolo string, data string, tipologia array<string>, argomenti array<string>, estratto string, url_documento string, docweb_id string")
    export.write_csv(listing, p("l"))
    assert tables.read_listing_csv(spark, p("l") + "/*.csv", p("none")).first().tipologia == ["x", "y"]
    assert tables.read_listing_csv(spark, p("none")).count() == 0
    import gzip

    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/17.html.gz").write_bytes(gzip.compress("<p>perché</p>".encode() + b"\xff"))
    assert tables.read_pages(spark, p("raw")).first() == (17, "<p>perché</p>�")
    s = spark.range(10).select("id", (F.col("id") % 3).alias("s"))
    assert export.write_slices(s, p("s"), "k", "s") == 3 and export.write_slices(s, p("s"), "k", "s") == 0 and spark.read.parquet(p("s/key=k")).count() == 10
    assert export.content_hash(s, "k") == export.content_hash(s.repartition(3), "k") != export.content_hash(s.limit(9), "k")
    export.write_json_record(spark.createDataFrame([(1, "x")], "a int, b string"), p("m"))
    assert spark.read.json(p("m")).first() == (1, "x")
    assert [tuple(r) for r in export.dense_codes(spark.createDataFrame([(5,), (3,), (5,), (None,)], "v long"), "v").orderBy("code").collect()] == [(3, 0), (5, 1)]


def test_hot_keys_take_the_other_way(spark):
    from corpuscle.session import skew_join

    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(50)], "k string, i int")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    got = skew_join(left, right, ["k"], "n", 3050)
    assert got.count() == 3050 and got.where("k = 'hot' and n = 3000").count() == 3000


def test_pairs_of_a_hot_key(spark):
    from corpuscle.session import pairs_within

    rows = [(i, 1 if i < 60 else i % 7, i * 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, key int, n int")
    want = {(a, b, na, nb) for a, k, na in rows for b, j, nb in rows if a < b and k == j}
    for cell in (2000, 7):
        got = [tuple(r) for r in pairs_within(df, ["key"], extra=["n"], cell=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_stored_index(spark, tmp_path):
    c, q, path = chunks(spark), queries(spark), str(tmp_path / "index")
    with pytest.raises(ValueError, match="write_index"):
        search.read_index(c, path)
    key = search.write_index(c, path)
    assert search.write_index(c, path) == key == search.stored_key(spark, path)
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert rows(search.search(c, q, postings=search.read_index(c, path))) == rows(search.search(c, q))
    with pytest.raises(ValueError):
        search.read_index(c.where("chunk_id <> '1_000'"), path)
    with pytest.raises(ValueError):
        search.read_index(c, path, stemmed=False)


def test_embedding_hook(spark, tmp_path):
    def encode(texts):
        return [[len(t), 1.0] for t in texts]

    got = {r.chunk_id: r.embedding for r in search.embed(chunks(spark), encode, "lengths", str(tmp_path)).collect()}
    assert set(got) == {"1_000", "1_001", "2_000", "3_000", "4_000"} and got["3_000"] == [0.0, 1.0]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-6 for v in got.values())
    search.embed(chunks(spark), lambda t: [[1.0]] * len(t), "ones", str(tmp_path))
    assert search.read_vectors(spark, str(tmp_path), "lengths").first().model == "lengths" and search.read_vectors(spark, str(tmp_path), "ones").count() == 5


def test_search_index_with_manifest(spark, tmp_path):
    import hashlib

    files = export.write_search_index(chunks(spark), str(tmp_path), "abc").collect()
    assert {f.file.split("/")[0] for f in files} >= {"chunks", "sections", "types", "decisions", "vectors"}
    for f in files:
        data = (tmp_path / "abc" / f.file).read_bytes()
        assert len(data) == f.bytes and hashlib.sha256(data).hexdigest() == f.sha256
    types = {r.value: r.code for r in spark.read.parquet(str(tmp_path / "abc/types")).collect()}
    assert types == {"Parere": 0, "Provvedimenti": 1}
    export.write_pages(spark.createDataFrame([(1, "<p>a</p>")], "docweb_id long, html string"), str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).first().html == "<p>a</p>"


def test_rules_of_procedure_and_missing_documents(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    d = spark.createDataFrame([(1, ["Regolamento del Garante"]), (2, ["Parere"]), (3, None), (4, [])], "docweb_id long, tipologia array<string>")
    assert sorted(tuple(r) for r in analysis.without_procedural(e, d).collect()) == [(2, 3), (3, 4)]
    assert [r.docweb_id for r in export.missing_documents(d, spark.createDataFrame([(1,), (9,), (9,), (None,)], "docweb_id long")).collect()] == [9]


def test_listing_stops_where_all_is_known(spark):
    listing = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 3), (3, 3), (3, 4), (4, 13), (2, None)], "page int, docweb_id long")
    known = spark.createDataFrame([(3,), (4,), (None,)], "docweb_id long")
    assert sorted(tuple(r) for r in state.until_known(listing, known).collect()) == [(1, 2), (2, 1), (3, 0)]
    assert state.until_known(listing.where("page < 3"), known).count() == 2 and state.until_known(listing.limit(0), known).count() == 0
