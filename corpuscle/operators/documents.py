"""Selection of documents, families of near-identical ones, mining of repeated wording, and chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import columns as C
from corpuscle.functions import italian as it
from corpuscle.functions import segment
from corpuscle.operators.components import connected_components
from corpuscle.session import materialise, pairs_within, small, spread


def newest() -> list[Column]:
    """Order of documents: newest first, undated last, then the greatest id."""
    return [F.desc_nulls_last("date"), F.desc("docweb_id")]


def arrow_map(df: DataFrame, inputs: list[str], fn: Callable[..., dict], outputs: str, keep: list[str]) -> DataFrame:
    """Rows of `keep` with the fields that fn(*inputs) gives, in Arrow batches. An error of fn fails that row only: its fields
    are null, and the message is in `error`."""
    ddl = ", ".join(f"`{k}` {t}" for k, t in df.select(*keep).dtypes)
    schema = f"{ddl}, {outputs}, error string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(f"{outputs}, error string"))
    names = types.names[:-1]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs]
            out: dict[str, list] = {n: [] for n in [*names, "error"]}
            for args in zip(*cols):
                try:
                    got = fn(*args) | {"error": None}
                except Exception as e:  # noqa: BLE001 - one bad document must not end the run
                    got = {"error": repr(e)}
                for n in out:
                    out[n].append(got.get(n))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), *(pa.array(out[n], types.field(n).type) for n in out)], names=[*keep, *out])

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)


def reject_reason(body: Column, chars: Column, native_chars: Column | None = None) -> Column:
    """First of the tests a document fails; null if it passes those that need no other document."""
    reason = F.when(chars < it.MIN_BODY_CHARS, "short_or_empty").when(body.rlike(it.STUB), "redirect_stub")
    return reason if native_chars is None else reason.when(native_chars < it.MIN_BODY_CHARS, "english")


META = ["docweb_id", "title", "date", "url", "tipologia", "argomenti", "body_chars", "body_sha256"]
_PARAGRAPHS = "array<struct<section: string, paragraph: string, number: string, key: string, sentences: array<string>>>"


def _outline(body: str | None, title: str | None) -> dict:
    ps = segment.paragraphs(body)
    rows = segment.sections(ps, title)
    return {
        "native_chars": len(" ".join(ps)),
        "p": [{"section": s, "paragraph": p, "number": segment.heading_number(p), "key": segment.paragraph_key(p), "sentences": segment.sentences(p)} for s, p in rows],
    }


def outlines(docs: DataFrame) -> DataFrame:
    """The documents (META, and `tag`, a number of the row) with `reason` and their paragraphs `p`, cut once for all later steps."""
    base = spread(docs).withColumn("tag", F.monotonically_increasing_id()).withColumn("body", F.coalesce("body", F.lit(""))).withColumn("body_chars", F.coalesce("body_chars", F.lit(0)))
    base = base.withColumn("early", reject_reason(F.col("body"), F.col("body_chars")))
    cut = arrow_map(base, ["body", "title"], _outline, f"native_chars int, p {_PARAGRAPHS}", [*(c for c in META if c in base.columns), "tag", "early"])
    return cut.withColumn("reason", F.coalesce("early", F.when(F.col("native_chars") < it.MIN_BODY_CHARS, "english"))).drop("early", "native_chars", "error")


def select_documents(docs: DataFrame, n: int | None = None, language: bool = True) -> DataFrame:
    """The rows of `docs` (META) with `verdict`: keep, short_or_empty, redirect_stub, english or duplicate_body.

    Of bodies with an equal hash the newest is kept, among documents that pass the other tests (of rows that are equal in
    date and id too, one). With n, the documents after the n-th kept one, newest first, are left out, as they are never looked
    at. Null bodies count as empty; a null hash equals no other. With language=False the test for English documents, which
    needs the paragraphs, is left out. Bodies are read once and not shuffled."""
    if language:
        light = outlines(docs).drop("p")
    else:
        reason = reject_reason(F.coalesce("body", F.lit("")), F.coalesce("body_chars", F.lit(0)))
        light = docs.select(*(c for c in META if c in docs.columns), reason.alias("reason")).withColumn("tag", F.monotonically_increasing_id())
    return _verdicts(materialise(light, "light"), n)


def _verdicts(rows: DataFrame, n: int | None) -> DataFrame:
    """`rows` (META, tag, reason; written, so that tags stay) with `verdict`. The newest of each hash is found by an aggregate that
    combines before the shuffle, so a body that a third of the documents share is no hot key."""
    sha = F.coalesce("body_sha256", F.concat(F.lit("row"), F.col("tag").cast("string")))
    fit = rows.where("reason is null").select(sha.alias("sha"), F.struct(F.coalesce("date", F.lit("")), "docweb_id", "tag").alias("at"))
    kept = fit.groupBy("sha").agg(F.max("at").alias("at")).select(F.col("at.tag").alias("tag"), F.lit("keep").alias("kept"))
    out = rows.join(kept, "tag", "left").withColumn("verdict", F.coalesce("reason", "kept", F.lit("duplicate_body"))).drop("kept", "reason")
    if n is None:
        return out.drop("tag")
    if n <= 0:
        return out.drop("tag").limit(0)
    last = out.where("verdict = 'keep'").select("date", "docweb_id").orderBy(*newest()).limit(n).agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("date", F.lit("")).alias("day"), "docweb_id")).alias("x")).first()
    edge = F.struct(F.lit(last.x.day if last.x else "").alias("day"), F.lit(last.x.docweb_id if last.x else 0).alias("docweb_id"))
    return (out if last.n < n else out.where(F.struct(F.coalesce("date", F.lit("")).alias("day"), "docweb_id") >= edge)).drop("tag")


def _sequences(batches):
    """Five-word sequences as hashes: words are hashed once each, sequences by vector steps over the words' hashes."""
    import re

    import numpy as np
    import pyarrow as pa
    import xxhash

    n, step = it.SHINGLE_WORDS, np.uint64(0x100000001B3)
    for b in batches:
        known: dict[str, int] = {}
        sets = []
        for body in b.column(1).to_pylist():
            plain = re.sub(r"\bx{2,}\b|\[omissis\]", "x", re.sub(r"\d+", "0", (body or "").lower()))
            words = re.findall(r"\w+", plain)
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.array([known[w] for w in words], dtype=np.uint64)
            rows = np.lib.stride_tricks.sliding_window_view(h, n) if len(h) >= n else h[None, :]
            acc = np.zeros(len(rows), np.uint64)
            for k in range(rows.shape[1]):
                acc = (acc ^ rows[:, k]) * step
                acc ^= acc >> np.uint64(32)
            sets.append(np.unique(acc).view(np.int64) if len(h) else np.zeros(0, np.int64))
        offsets = pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], names=["id", "s"])


def shingles(docs: DataFrame, id_col: str = "docweb_id", body_col: str = "body") -> DataFrame:
    """(id, s): distinct hashes of five-word sequences (of all words if there are fewer), once per id; ids without any word
    are left out. In JVM expressions this is quadratic: lambdas compute the word list anew for each position."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(body_col).alias("body"))
    return rows.mapInArrow(_sequences, f"id {dict(rows.dtypes)['id']}, s array<bigint>").where("size(s) > 0").dropDuplicates(["id"])


def _sign(batches):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, it.PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, it.PERMUTATIONS, dtype=np.uint64)
    mix = rng.integers(0, 2**63, it.BAND_ROWS, dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        bands = []
        for s in batch.column(1):
            h = np.asarray(s.values).view(np.uint64)
            sig = np.concatenate([(((h[:, None] ^ (h[:, None] >> np.uint64(31))) * a[i : i + 32] + b[i : i + 32]) >> np.uint64(20)).min(0) for i in range(0, len(a), 32)])
            bands.append((sig.reshape(it.BANDS, it.BAND_ROWS) * mix).sum(1, dtype=np.uint64).view(np.int64))
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), it.BANDS)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(it.BANDS, dtype=np.int32), batch.num_rows)), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))], names=["id", "band", "key"])


def minhash_bands(sets: DataFrame) -> DataFrame:
    """(id, band, key): 128 minima of each set in 32 bands of 4."""
    return sets.select("id", "s").mapInArrow(_sign, f"id {dict(sets.dtypes)['id']}, band int, key long")


#: Longs of the parity map of a set: bit h % (64 * PARITY) is set if an odd number of its elements has it.
PARITY = 16


def _classes(batches):
    """Sets of sequences with a hash that tells them apart; texts without words have none."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    for b in _sequences(batches):
        same = pa.array([xxhash.xxh64_intdigest(x.values.to_numpy().tobytes()) - 2**63 for x in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), same, b.column(1)], names=["id", "class", "s"]).filter(pc.greater(pc.list_value_length(b.column(1)), 0))


def _marks(batches):
    """What is known of a set without having it at hand: class, size, parity map, and the keys of its bands."""
    import numpy as np
    import pyarrow as pa

    size = 64 * PARITY
    for b in _classes(batches):
        sets = [x.values.to_numpy().view(np.uint64) for x in b.column(2)]
        maps = [np.packbits((np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.int64) for s in sets]
        keys = [k for banded in _sign([b.select([0, 2])]) for k in banded.column(2).to_numpy()]
        lists = lambda flat, n: pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int32()), lists(np.concatenate(maps) if maps else np.zeros(0, np.int64), PARITY), lists(np.array(keys, np.int64), it.BANDS)], names=["id", "class", "n", "m", "keys"])


def families(docs: DataFrame, threshold: float = it.DUP_JACCARD, band_rows: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(docweb_id, representative): families of near-identical documents, by their newest member.

    Equal sets of sequences are one class and take part once. In each bucket of a band, all classes are held against each
    other, each pair once however many buckets it shares. A pair must first pass two exact tests that need no sets: sizes in
    proportion, and parity maps that differ in no more bits than the sets may in elements. Sets are made again for those only
    that pass, so no set of the rest is ever moved. Matches of exact Jaccard at or above the threshold are joined to components.
    Documents without words are families of one; an id with several texts counts by one of them. `band_rows` makes (id, n, band,
    key) of (id, n, keys) and is there for tests."""
    rows = spread(docs).select(F.col("docweb_id").alias("id"), "body").where("id is not null")
    id_type = dict(rows.dtypes)["id"]
    signed = materialise(rows.mapInArrow(_marks, f"id {id_type}, class bigint, n int, m array<bigint>, keys array<bigint>"), "signed")
    own = materialise(signed.groupBy("id").agg(F.max("class").alias("class")), "own")
    reps = own.groupBy("class").agg(F.min("id").alias("rep"))
    one = materialise(signed.join(reps.select(F.col("rep").alias("id"), "class"), ["id", "class"], "left_semi").dropDuplicates(["id"]), "classes")
    bands = one.select("id", "n", F.posexplode("keys").alias("band", "key")) if band_rows is None else band_rows(one)
    shared = materialise(bands.groupBy("band", "key").agg(F.count("*").alias("held")).where("held > 1").select("band", "key"), "shared")
    bands = materialise(bands.join(small(shared), ["band", "key"], "left_semi"), "bands")
    pairs = pairs_within(bands, ["band", "key"], extra=["n"]).where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-6).select("a", "b").distinct()
    x, y = (one.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("m").alias(f"m{k}")) for k in "ab")
    differ = sum((F.bit_count(F.get("ma", F.lit(i)).bitwiseXOR(F.get("mb", F.lit(i)))) for i in range(PARITY)), F.lit(0))
    most = F.col("na") + F.col("nb") - 2 * F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    likely = materialise(pairs.join(x, "a").join(y, "b").where(differ <= most).select("a", "b"), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(one.select("id", "class"), "id")
    sets = rows.join(small(wanted.select("id")), "id", "left_semi").mapInArrow(_classes, f"id {id_type}, class bigint, s array<bigint>")
    sets = materialise(sets.join(small(wanted), ["id", "class"], "left_semi").dropDuplicates(["id"]), "sets")
    x, y = (sets.select(F.col("id").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    close = likely.join(x, "a").join(y, "b").where(common / (F.size("sa") + F.size("sb") - common) >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    copies = own.join(reps, "class").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    comp = connected_components(docs.select(F.col("docweb_id").alias("id")).where("id is not null"), close.unionByName(copies))
    dated = comp.join(docs.select(F.col("docweb_id").alias("id"), F.coalesce("date", F.lit("")).alias("d")).distinct(), "id")
    newest = dated.groupBy("component").agg(F.max_by("id", F.struct("d", "id")).alias("representative"))
    return comp.join(newest, "component").select(F.col("id").alias("docweb_id"), "representative")


def family_map(docs: DataFrame, fam: DataFrame) -> DataFrame:
    """One row per twin: (docweb_id of the representative, similar_docweb_id, date, title, url of the twin)."""
    info = docs.select(F.col("docweb_id").alias("similar_docweb_id"), "date", "title", "url").dropDuplicates(["similar_docweb_id"])
    twins = fam.where("docweb_id <> representative").select(F.col("representative").alias("docweb_id"), F.col("docweb_id").alias("similar_docweb_id"))
    return twins.join(info, "similar_docweb_id").select("docweb_id", "similar_docweb_id", "date", "title", "url")


def paragraphs(cut: DataFrame) -> DataFrame:
    """(docweb_id, para_no, section, paragraph, number, key) of outlines(), after line joining, translation cut and section labels."""
    return cut.select("docweb_id", F.posexplode("p").alias("para_no", "x")).select("docweb_id", "para_no", "x.section", "x.paragraph", "x.number", "x.key")


def sentences(cut: DataFrame) -> DataFrame:
    """(docweb_id, para_no, sentence_no, section, sentence) of outlines()."""
    ps = cut.select("docweb_id", F.posexplode("p").alias("para_no", "x"))
    return ps.select("docweb_id", "para_no", F.col("x.section").alias("section"), F.posexplode("x.sentences").alias("sentence_no", "sentence"))


def _long_wording(cut: DataFrame) -> DataFrame:
    return paragraphs(cut).where((F.length("paragraph") >= it.BOILERPLATE_MIN_CHARS) & F.col("number").isNull())


def boilerplate_keys(cut: DataFrame, min_docs: int = it.BOILERPLATE_MIN_DOCS) -> DataFrame:
    """(key, docs): wording of paragraphs in at least min_docs documents; numbered headings are none. Give representatives."""
    return _long_wording(cut).groupBy("key").agg(F.count_distinct("docweb_id").alias("docs")).where(F.col("docs") >= min_docs)


def boilerplate(cut: DataFrame, keys: DataFrame) -> DataFrame:
    """(docweb_id, para_no) of the paragraphs with that wording."""
    return _long_wording(cut).select("docweb_id", "para_no", "key").join(small(keys.select("key")), "key", "left_semi").select("docweb_id", "para_no")


def sentence_phrases(cut: DataFrame, boiler: DataFrame) -> DataFrame:
    """(docweb_id, argomenti, para_no, sentence_no, section, words, open, ph) of all sentences but those of boilerplate: `ph` are the
    distinct five-word phrases, `open` says that the sentence may be left out. A heading counts once more as a whole, under number -1."""
    gone = boiler.groupBy("docweb_id").agg(F.collect_set("para_no").alias("gone"))

    def phrases(ps, gone):
        dropped, out = set(gone or ()), []
        for no, p in enumerate(ps):
            if no not in dropped:
                whole = [(-1, p["paragraph"])] if p["number"] else []
                out += [{"para_no": no, "sentence_no": k, "section": p["section"], "words": segment.count_words(s), "open": segment.may_be_formula(s), "ph": list(segment.phrases(s))} for k, s in [*whole, *enumerate(p["sentences"])]]
        return {"s": out}

    fields = "para_no: int, sentence_no: int, section: string, words: int, open: boolean, ph: array<string>"
    rows = arrow_map(cut.join(small(gone), "docweb_id", "left"), ["p", "gone"], phrases, f"s array<struct<{fields}>>", ["docweb_id", "argomenti"])
    return rows.select("docweb_id", "argomenti", F.explode("s").alias("s")).select("docweb_id", "argomenti", "s.*")


def hashed(said: DataFrame) -> DataFrame:
    """sentence_phrases() with hashes for phrases, which is what the later steps count and join."""
    return said.withColumn("ph", F.transform("ph", lambda x: F.xxhash64(x)))


def phrase_texts(said: DataFrame, procedural: DataFrame) -> DataFrame:
    """`procedural` with the wording of its phrases, out of sentence_phrases()."""
    held = said.select(F.explode("ph").alias("text")).select(F.xxhash64("text").alias("phrase"), "text")
    texts = held.join(small(procedural.select("phrase")), "phrase", "left_semi").groupBy("phrase").agg(F.min("text").alias("text"))
    return procedural.join(texts, "phrase").select(F.col("text").alias("phrase"), "docs", "tagged", "top_tag")


def procedural_phrases(said: DataFrame, min_docs: int = it.BOILERPLATE_MIN_DOCS, min_tagged: int = it.FORMULA_MIN_TAGGED, max_topic: float = it.FORMULA_MAX_TOPIC) -> DataFrame:
    """(phrase, docs, tagged, top_tag): hashes of five-word phrases of min_docs documents or more that no single topic dominates,
    out of hashed() sentences.

    Frequent phrases are found first, and only their rows are joined with the topics. Empty if no document has topics."""
    of_doc = materialise(said.where("sentence_no >= 0").select("docweb_id", F.explode("ph").alias("phrase")).distinct(), "phrases")
    often = materialise(of_doc.groupBy("phrase").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs), "often")
    topics = said.select("docweb_id", F.array_distinct("argomenti").alias("topics")).where("size(topics) > 0").distinct()
    kept = materialise(of_doc.join(small(often), "phrase").join(topics, "docweb_id"), "tagged")
    tags = kept.select("phrase", F.explode("topics").alias("tag")).groupBy("phrase", "tag").agg(F.count("*").alias("n")).groupBy("phrase").agg(F.max("n").alias("top_tag"))
    tagged = kept.groupBy("phrase", "docs").agg(F.count("*").alias("tagged"))
    return tagged.join(tags, "phrase").where((F.col("tagged") >= min_tagged) & (F.col("top_tag") <= max_topic * F.col("tagged"))).select("phrase", "docs", "tagged", "top_tag")


def formulas(said: DataFrame, procedural: DataFrame) -> DataFrame:
    """(docweb_id, para_no, sentence_no, section, words) of the sentences that are mostly procedural phrases. An inner join with
    the mined phrases, by broadcast where these are few, and a count per sentence."""
    held = said.where("open").select("docweb_id", "para_no", "sentence_no", "section", "words", F.size("ph").alias("n"), F.explode("ph").alias("phrase"))
    hits = held.join(small(procedural.select("phrase")), "phrase").groupBy("docweb_id", "para_no", "sentence_no", "section", "words", "n").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= F.col("n") * it.FORMULA_MIN_SHARE).drop("n", "hits")


def chunk(cut: DataFrame, boiler: DataFrame | None = None, formula: DataFrame | None = None, twins: DataFrame | None = None, tokens: Callable[[str], int] = segment.count_words) -> DataFrame:
    """Chunks of the documents of outlines() (representatives), in the schema of the table `chunks`, without vectors.

    `boiler` (docweb_id, para_no) and `formula` (docweb_id, para_no, sentence_no) are left out; a heading with formula -1 loses
    its title. `tokens` counts the tokens of a string; `twins` (docweb_id, similar_docweb_id) gives similar_count. Documents
    without text have no chunks."""
    spark = cut.sparkSession
    none = spark.createDataFrame([], "docweb_id bigint, para_no int, sentence_no int")
    gone = (boiler.select("docweb_id", "para_no", F.lit(None).cast("int").alias("sentence_no")) if boiler is not None else none).unionByName(formula.select("docweb_id", "para_no", "sentence_no") if formula is not None else none)
    out = gone.groupBy("docweb_id").agg(F.collect_list(F.struct("para_no", "sentence_no")).alias("gone"))

    def pack(ps, gone):
        lost = {(g["para_no"], g["sentence_no"]) for g in gone or ()}
        rows = [
            segment.Paragraph(p["section"], p["number"], "" if not p["number"] or (no, -1) in lost else it.NUMBERED.sub("", p["paragraph"]).rstrip(" ."), [s for k, s in enumerate(p["sentences"]) if (no, k) not in lost])
            for no, p in enumerate(ps)
            if (no, None) not in lost
        ]
        return {"c": [c | {"section_shares": list(c["section_shares"].items())} for c in segment.chunks(rows, tokens)]}

    meta = ["docweb_id", "title", "date", "url", "tipologia", "argomenti"]
    got = arrow_map(cut.join(small(out), "docweb_id", "left"), ["p", "gone"], pack, "c array<struct<text: string, section: string, section_shares: map<string, double>, heading: string, weight: double>>", meta)
    rows = got.select(*meta, F.posexplode("c").alias("chunk_index", "c")).select(*meta, "chunk_index", "c.*")
    if twins is not None:
        n = twins.groupBy("docweb_id").agg(F.count("*").cast("int").alias("similar_count"))
        rows = rows.join(small(n), "docweb_id", "left")
    else:
        rows = rows.withColumn("similar_count", F.lit(None).cast("int"))
    header = C.chunk_header(*(F.col(c) for c in ("title", "date", "tipologia", "argomenti", "section", "heading")))
    rows = rows.withColumn("similar_count", F.coalesce("similar_count", F.lit(0))).withColumn("embed_text", F.concat(header, F.lit("\n\n"), F.col("text")))
    # the default counter, words, needs no Python
    count = F.regexp_count("embed_text", F.lit(r"(?U)\S+")) if tokens is segment.count_words else F.pandas_udf(lambda s: s.map(tokens), "int")("embed_text")
    rows = rows.withColumn("n_tokens", count).withColumn("chunk_id", F.format_string("%d_%03d", "docweb_id", "chunk_index"))
    order = "chunk_id docweb_id chunk_index title date url tipologia argomenti section section_shares heading similar_count weight text embed_text n_tokens".split()
    return rows.select(*order)


def dropped_words(formula: DataFrame) -> DataFrame:
    """(section, words) left out of chunks with procedural sentences."""
    return formula.where("sentence_no >= 0").groupBy("section").agg(F.sum("words").alias("words")).where("words > 0")


class Mined:
    """Selection, families and mined wording of a corpus: tables that are made when they are asked for, and made once."""

    def __init__(self, docs: DataFrame, n: int | None = None):
        self.docs, self.n = docs, n

    @cached_property
    def kept(self) -> DataFrame:
        cut = materialise(outlines(self.docs), "outlines")
        return materialise(_verdicts(cut, self.n).where("verdict = 'keep'").drop("verdict"), "kept")

    @cached_property
    def families(self) -> DataFrame:
        bodies = spread(self.docs).select("docweb_id", "body", "date").join(small(self.kept.select("docweb_id")), "docweb_id", "left_semi")
        return materialise(families(bodies), "families")

    @cached_property
    def twins(self) -> DataFrame:
        return materialise(family_map(self.kept, self.families), "twins")

    @cached_property
    def reps(self) -> DataFrame:
        return materialise(self.kept.join(self.families.where("docweb_id = representative").select("docweb_id"), "docweb_id", "left_semi"), "reps")

    @cached_property
    def keys(self) -> DataFrame:
        return materialise(boilerplate_keys(self.reps), "keys")

    @cached_property
    def boiler(self) -> DataFrame:
        return materialise(boilerplate(self.reps, self.keys), "boiler")

    @cached_property
    def said(self) -> DataFrame:
        return materialise(hashed(sentence_phrases(self.reps, self.boiler)), "said")

    @cached_property
    def procedural(self) -> DataFrame:
        return materialise(procedural_phrases(self.said), "procedural")

    @cached_property
    def formulas(self) -> DataFrame:
        return materialise(formulas(self.said, self.procedural), "formulas")


def build_index(docs: DataFrame, n: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selection, families, mining and chunking in one go: (chunks, family map, one row of figures)."""
    m = Mined(docs, n)
    out = materialise(chunk(m.reps, m.boiler, m.formulas, m.twins), "chunks")
    sizes = m.families.groupBy("representative").agg(F.count("*").alias("n"))
    largest = [r.n for r in sizes.orderBy(F.desc("n")).limit(5).collect()]
    figures = (
        m.kept.agg(F.count("*").alias("documents"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        .join(sizes.agg(F.count("*").alias("indexed_documents"), F.count_if(F.col("n") > 1).alias("template_families")))
        .join(out.agg(F.count("*").alias("chunks")))
        .join(m.keys.agg(F.count("*").alias("boilerplate_paragraphs")))
        .join(m.procedural.agg(F.count("*").alias("procedural_phrases")))
        .withColumn("largest_families", F.array(*map(F.lit, largest)).cast("array<bigint>"))
        .withColumn("chunks_per_doc", F.round(F.col("chunks") / F.col("indexed_documents"), 2))
    )
    return out, m.twins, figures
