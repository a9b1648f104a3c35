import hashlib

from corpuscle.functions import pages as P

PAGE = """<html><head><title>Prova - Garante Privacy</title><meta name="robots" content="NoArchive"><meta property="og:title" content=" Provvedimento del 5 marzo [12345] ">
<script>var x = "Scheda";</script></head><body><nav><a href="/x">menu</a></nav><h1>Provvedimento</h1>
<p>[doc. web n. 12345]</p><p>Registro dei provvedimenti<br>n. 77 del 5 marzo 2020</p><p>Multa di euro 24.000 (ventiquattromila) e euro 20.000,50 (ventimila), vedi doc. web n. 99999; il sig. XX &amp; altri</p>
<a href="/documents/1/a.pdf?v=1">atto</a><h2>Scheda</h2><p>Data 05/03/20</p><a href="/search/tipologia/P">Provvedimento</a><a href="/search/argomento/S">Sanità</a><a href="/search/argomento/S">Sanità</a>
<h2>Vedi anche (2)</h2><a href="/docweb/-/docweb-display/docweb/111">uno</a><a href="doc.jsp?ID=222">due</a><h3>Documenti citati</h3><a href="/docweb/-/docweb-display/docweb/333">tre</a><h2>Footer</h2><a href="/docweb/-/docweb-display/docweb/444">no</a></body></html>"""

LISTING = """<body><div>1.234 risultati di ricerca</div><ul><li><strong><a href="/docweb/-/docweb-display/docweb/1">Primo</a></strong> 01/02/2020 <a href="/search/tipologia/x">Parere</a></li>
<li><strong><a href="/docweb/-/docweb-display/docweb/2">Secondo</a></strong></li></ul><a href="/docweb/-/docweb-display/docweb/9">L'agenda</a></body>"""


STATE = "docweb_id long, fetch_status int, list_date string, tipologia string, argomenti string"


def parsed(spark, i, html, date=None, types=None):
    from corpuscle.operators.parse import parse_documents

    state = spark.createDataFrame([(i, 200, date, types, None)], STATE)
    return parse_documents(spark.createDataFrame([(i, html)], "docweb_id long, html string"), state, "u/{id}", " - Sito").first()


def test_document(spark):
    d = parsed(spark, 12345, PAGE)
    assert d["title"] == "Provvedimento del 5 marzo [12345]" and d["date"] == "2020-03-05" and d["era"] == "gdpr" and d["url"] == "u/12345"
    assert d["tipologia"] == ["Provvedimento"] and d["argomenti"] == ["Sanità"] and d["registro_n"] == 77
    assert d["fines_eur"] == [20000.5, 24000.0] and d["refs_in_text"] == [99999] and d["xx_placeholders"] == 1
    assert d["see_also"] == [111, 222] and d["cites"] == [333] and d["attachments"] == ["/documents/1/a.pdf?v=1"] and d["noarchive"]
    assert d["body_method"] == "docweb_marker" and d["body"].startswith("[doc. web n. 12345]") and "Scheda" not in d["body"] and "& altri" in d["body"]
    assert d["body_chars"] == len(d["body"]) and d["body_sha256"] == hashlib.sha256(d["body"].encode()).hexdigest() and d["error"] is None


def test_fallbacks(spark):
    d = parsed(spark, 1, "<html></html>")
    assert d["body_method"] == "failed" and d["body"] == "" and d["tipologia"] == [] and d["date"] is None
    d = parsed(spark, 1, "<title>T x - Sito</title><p>T x</p><p>Stampa</p><p>testo</p>", "01/02/99", '["a"]')
    assert d["body"] == "testo" and d["body_method"] == "title_fallback" and d["date"] == "1999-02-01" and d["tipologia"] == ["a"] and d["argomenti"] == []
    d = parsed(spark, 2, "<title>T</title><p>T</p><p>uno</p><p>T</p><p>due</p><p>Footer</p><p>T</p><p>tre</p>")
    assert d["title"] == "T" and d["body"] == "due"


def test_dates(spark):
    from pyspark.sql import functions as F

    from corpuscle.functions import columns as C

    want = {"03/12/99": "1999-12-03", "01/02/18": "2018-02-01", "31/02/2020": None, "1/2/2020": None, None: None, " 01/02/2018 ": "2018-02-01"}
    got = spark.createDataFrame([(s,) for s in want], "s string").select("s", C.iso_date(F.col("s")).alias("d")).collect()
    assert {r.s: r.d for r in got} == want


def test_listing():
    total, items = P.parse_listing(LISTING)
    assert total == 1234 and [i["docweb_id"] for i in items] == [1, 2]
    assert items[0] == {"docweb_id": 1, "title": "Primo", "list_date": "01/02/2020", "tipologia": ["Parere"], "argomenti": [], "listing_text": "Primo 01/02/2020 Parere"}
    assert P.parse_listing("") == (None, [])


def test_cards():
    html = '<ul class="pagination"><a class="page-link">1</a><a class="page-link">7</a><a class="page-link">Next</a></ul><div class="card-risultato"><a class="titolo-risultato" href="/x/docweb/55">T</a><div class="data-risultato"><p>01/01/2020</p></div><p class="estratto-risultato">e</p><a href="/search/tipologia/a">A</a><a href="/search/tipologia/b">B</a></div>'
    n, rows = P.parse_cards(html, "https://h.example")
    assert n == 7 and rows == [{"titolo": "T", "data": "01/01/2020", "tipologia": "A; B", "argomenti": "", "estratto": "e", "url_documento": "https://h.example/x/docweb/55", "docweb_id": "55"}]
    assert P.parse_cards("") == (1, [])


def test_parse_operators(spark):
    from corpuscle.operators.parse import parse_card_pages, parse_documents, parse_listings, parse_report

    state = spark.createDataFrame([(12345, 200, "01/01/2019", '["L"]', '["M"]'), (2, 200, None, None, None), (3, 404, None, None, None)], "docweb_id long, fetch_status int, list_date string, tipologia string, argomenti string")
    pages = spark.createDataFrame([(12345, PAGE), (2, None), (3, PAGE)], "docweb_id long, html string")
    got = {r.docweb_id: r for r in parse_documents(pages, state).collect()}
    assert set(got) == {12345, 2} and got[12345].date == "2019-01-01" and got[2].error
    assert {(r.failed, r.pages) for r in parse_report(parse_documents(pages, state)).collect()} == {(False, 1), (True, 1)}
    assert [r.docweb_id for r in parse_listings(spark.createDataFrame([(1, LISTING)], "page int, html string")).orderBy("item_no").collect()] == [1, 2]
    assert parse_card_pages(spark.createDataFrame([(1, "")], "page int, html string")).count() == 0
