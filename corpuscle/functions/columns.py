"""Column expressions of the corpus, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions import italian as it


def squeeze(c: Column) -> Column:
    """White space of any kind collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def paragraph_key(c: Column) -> Column:
    """A paragraph without regard to letter case, numbers and spacing."""
    return squeeze(F.regexp_replace(F.lower(c), r"\d+", "0"))


def lines(body: Column) -> Column:
    """Squeezed lines of a body, without empty ones."""
    return F.filter(F.transform(F.split(body, r"\R"), squeeze), lambda x: x != "")


def words(c: Column) -> Column:
    """Words after making numbers and names of persons alike; letters of any alphabet count."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+", "0"), r"(?U)\bx{2,}\b|\[omissis\]", "x")
    return F.regexp_extract_all(plain, F.lit(r"(?U)(\w+)"), 1)


def tokens(c: Column) -> Column:
    """Search terms: lower-case runs of letters and digits of two characters or more that are no stopwords."""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"({it.WORD})"), 1)
    stop = F.array(*(F.lit(w) for w in it.STOPWORDS))
    return F.filter(found, lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))


def iso_date(c: Column) -> Column:
    """dd/mm/yyyy or dd/mm/yy as an ISO date; two-digit years from 90 on are of the 1900s; no such day gives null."""
    m = lambda k: F.regexp_extract(F.trim(c), r"^(\d{2})/(\d{2})/(\d{2}|\d{4})$", k)
    year = F.when(F.length(m(3)) == 4, m(3)).when(m(3) >= "90", F.concat(F.lit("19"), m(3))).otherwise(F.concat(F.lit("20"), m(3)))
    day = F.try_to_date(F.concat_ws("-", year, m(2), m(1)), "yyyy-MM-dd")
    return F.when(m(3) != "", F.date_format(day, "yyyy-MM-dd"))


def era(date: Column) -> Column:
    return F.when(date < it.GDPR_START, "pre_gdpr").when(date >= it.GDPR_START, "gdpr")


def year(date: Column) -> Column:
    """Year of an ISO date, 0 if there is none."""
    return F.coalesce(F.substring(date, 1, 4).try_cast("int"), F.lit(0))


def fines(body: Column) -> Column:
    """Distinct amounts "euro 20.000,00 (ventimila)" in ascending order."""
    whole = F.regexp_extract_all(body, F.lit(it.FINE), 1)
    cents = F.regexp_extract_all(body, F.lit(it.FINE), 2)
    amount = F.zip_with(whole, cents, lambda w, c: F.concat(F.replace(w, F.lit("."), F.lit("")), F.lit("."), F.when(c == "", "00").otherwise(c)).cast("double"))
    return F.array_sort(F.array_distinct(amount))


def registro(body: Column) -> Column:
    return F.regexp_extract(body, it.REGISTRO, 1).try_cast("int")


def references(body: Column, own: Column) -> Column:
    """Ids of other documents named in the text, in ascending order."""
    ids = F.transform(F.regexp_extract_all(body, F.lit(it.DOCWEB_TEXT), 1), lambda x: x.cast("bigint"))
    return F.array_sort(F.array_remove(F.array_distinct(ids), own))


def placeholders(body: Column) -> Column:
    return F.regexp_count(body, F.lit(r"(?U)\bXX\b"))


def roles(section: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in it.ROLES.items() for x in kv)), section)


def is_case(tipologia: Column) -> Column:
    return F.coalesce(F.arrays_overlap(tipologia, F.array(*(F.lit(t) for t in it.CASE_TYPES))), F.lit(False))


def in_scope(scope: str | None, section: Column, tipologia: Column) -> Column:
    """Chunks whose majority section has the scope's role; for violations, of decisions on a case only."""
    if scope is None:
        return F.lit(True)
    same = F.coalesce(roles(section) == scope, F.lit(False))
    return same & is_case(tipologia) if scope == "violation" else same


def effective_alpha(query: Column, alpha: float) -> Column:
    """Keyword share of a query: raised for numbers and quotes, but never from nothing."""
    if alpha <= 0:
        return F.lit(float(alpha))
    return F.when(query.rlike(it.EXACT_QUERY), F.lit(max(alpha, it.EXACT_QUERY_MIN_ALPHA))).otherwise(F.lit(float(alpha)))


def chunk_header(title: Column, date: Column, tipologia: Column, argomenti: Column, section: Column, heading: Column) -> Column:
    """The line before a chunk's text; empty parts are left out."""
    names = F.create_map(*(F.lit(x) for kv in it.SECTION_NAMES.items() for x in kv))
    part = lambda label, c, there: F.when(there, F.concat(F.lit(label), c))
    return F.concat_ws(
        " | ", title, F.concat(F.lit("Data: "), F.coalesce(date, F.lit("None"))),
        part("Tipologia: ", F.array_join(tipologia, ", "), F.size(tipologia) > 0), part("Argomenti: ", F.array_join(argomenti, ", "), F.size(argomenti) > 0),
        F.concat(F.lit("Sezione: "), names[section]), part("Paragrafo: ", heading, F.coalesce(heading, F.lit("")) != ""),
    )


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\[\]*_`$])", r"\\$1")


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def highlight(text: Column, query: str) -> Column:
    """Escaped text with the query's words of four letters or more marked, also where they are inflected."""
    import re

    out = F.replace(escape_html(text), F.lit("\n"), F.lit("<br>"))
    for w in sorted({w.lower() for w in re.findall(r"\w{4,}", query)} - set(it.STOPWORDS), key=lambda w: (-len(w), w)):
        start = re.sub(r"([^\w])", r"\\\1", w[: max(4, len(w) - 2)])
        out = F.regexp_replace(out, rf"(?iU)\b({start}\w*)", "<mark>$1</mark>")
    return out


def passage(text: Column, limit: int = it.PASSAGE_CHARS) -> Column:
    """At most `limit` characters, cut at a blank."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), r"(?s) [^ ]*$", ""), F.lit(" …")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
