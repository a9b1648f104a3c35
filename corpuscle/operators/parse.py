"""Raw pages to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import columns as C
from corpuscle.functions import italian as it
from corpuscle.functions import pages as P
from corpuscle.operators.documents import arrow_map
from corpuscle.sources.tables import DOCS_SCHEMA

LISTING_ITEM = "docweb_id bigint, title string, list_date string, tipologia array<string>, argomenti array<string>, listing_text string"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def with_body(pages: DataFrame) -> DataFrame:
    """`pages` (docweb_id, title, text) with `body` and `body_method`: what stands before the metadata box (else the footer), from
    the document's own number on; without that, what follows the last mention of the title, but for the site's buttons."""
    box = F.coalesce(*(F.nullif(F.regexp_instr("text", F.lit(rf"(?m)^{w}$")), F.lit(0)) for w in ("Scheda", "Footer")))
    above = pages.withColumn("above", F.when(box.isNotNull(), F.substring("text", F.lit(1), box - 1)).otherwise(F.col("text")))
    own = F.regexp_instr("above", F.concat(F.lit(r"(?i)\[\s*doc\.?\s*web\s*n\.?\s*"), F.col("docweb_id").cast("string"), F.lit(r"\s*\]")))
    below_title = F.filter(F.split(F.expr("substring_index(above, title, -1)"), "\n"), lambda ln: ~F.trim(ln).isin(*it.NOISE_LINES))
    titled = (F.col("title") != "") & F.contains("above", "title")
    method = F.when(F.col("text").isNull(), None).when(own > 0, "docweb_marker").when(titled, "title_fallback").otherwise("failed")
    body = F.when(own > 0, _stripped(F.substring("above", own, F.length("above")))).when(titled, _stripped(F.array_join(below_title, "\n"))).otherwise("")
    return above.withColumn("body_method", method).withColumn("body", F.when(method.isNotNull(), body)).drop("above")


def parse_documents(pages: DataFrame, state: DataFrame, url_pattern: str = "https://www.example.org/docweb/-/docweb-display/docweb/{id}", title_suffix: str = "") -> DataFrame:
    """Document records of fetched pages (docweb_id, html), with a column `error`: a page that can't be parsed is reported
    there and stops nothing. Labels and dates of the listing fill in where the page has none. Python reads the page's tree, everything
    else is column expressions. `title_suffix` is what the site puts behind every page's title."""
    strings = "array<string>"
    s = state.where("fetch_status = 200").select("docweb_id", "list_date", F.from_json("tipologia", strings).alias("listed_types"), F.from_json("argomenti", strings).alias("listed_topics")).dropDuplicates(["docweb_id"])
    read = arrow_map(pages, ["html"], P.page_fields, P.PAGE_FIELDS, ["docweb_id"]).join(s, "docweb_id")
    title = F.when(F.col("og_title") != "", F.col("og_title")).otherwise(F.when(F.lit(title_suffix != "") & F.endswith("html_title", F.lit(title_suffix)), F.expr(f"left(html_title, length(html_title) - {len(title_suffix)})")).otherwise(F.col("html_title")))
    date = F.coalesce(C.iso_date(F.col("list_date")), C.iso_date(F.regexp_extract("card", r"Data\s+(\d{2}/\d{2}/\d{2,4})", 1)))
    own_or = lambda own, listed: F.when(F.size(own) > 0, F.col(own)).otherwise(F.coalesce(listed, F.array().cast(strings)))
    r = with_body(read.withColumn("title", title).withColumn("date", date))
    b, before, after = F.col("body"), url_pattern.partition("{id}")[0], url_pattern.partition("{id}")[2]
    fields = {
        "url": F.concat(F.lit(before), F.col("docweb_id").cast("string"), F.lit(after)), "era": C.era(F.col("date")),
        "tipologia": own_or("types", "listed_types"), "argomenti": own_or("topics", "listed_topics"), "registro_n": C.registro(b), "fines_eur": C.fines(b),
        "refs_in_text": C.references(b, F.col("docweb_id")), "noarchive": F.contains(F.lower("robots"), F.lit("noarchive")), "xx_placeholders": C.placeholders(b),
        "body_chars": F.length(b), "body_sha256": F.sha2(b, 256),
    }
    r = r.withColumns(fields)
    return r.select(*(F.col(f.split()[0]).cast(f.split(" ", 1)[1]) for f in DOCS_SCHEMA.split(", ")), "error")


def parse_report(parsed: DataFrame) -> DataFrame:
    """(failed, pages): how many pages were parsed and how many not."""
    return parsed.groupBy(F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("pages"))


def parse_listings(pages: DataFrame) -> DataFrame:
    """(page, total, item_no, item fields) of listing pages (page, html)."""

    def fn(html):
        total, items = P.parse_listing(html)
        return {"total": total, "items": items}

    got = arrow_map(pages, ["html"], fn, f"total int, items array<struct<{', '.join(f.replace(' ', ': ', 1) for f in LISTING_ITEM.split(', '))}>>", ["page"])
    return got.select("page", "total", F.posexplode("items").alias("item_no", "x")).select("page", "total", "item_no", "x.*")


def parse_card_pages(pages: DataFrame, base_url: str = "") -> DataFrame:
    """(page, pages, card fields) of the older listing's pages (page, html)."""

    def fn(html):
        n, rows = P.parse_cards(html, base_url)
        return {"pages": n, "cards": rows}

    names = "titolo data tipologia argomenti estratto url_documento docweb_id".split()
    got = arrow_map(pages, ["html"], fn, f"pages int, cards array<struct<{', '.join(f'{n}: string' for n in names)}>>", ["page"])
    return got.select("page", "pages", F.explode("cards").alias("x")).select("page", "pages", "x.*")
