"""Lines repeated across one site's documents: template mining with fixed-depth token trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import BROADCAST_ROWS, materialise, skew_join, small

WILD = "*"


def line_key(line: str) -> str:
    """What makes two lines the same: lower case, digit runs alike, white space alike, nothing but letters and digits
    at either end. Empty if nothing is left."""
    import re

    return re.sub(r"^[\W_]+|[\W_]+$", "", " ".join(re.sub(r"\d+", "0", line.lower()).split()))


def tree_path(tokens: list[str], depth: int) -> str:
    """The leaf of the fixed-depth tree: number of tokens, then the first `depth` tokens, those with digits as wildcards."""
    return " ".join([str(len(tokens)), *(WILD if any(c.isdigit() for c in t) else t for t in tokens[:depth])])


class Leaf:
    """The templates of one leaf, all of one length. Of each slot's words an index says which templates have them, so a line is
    held against those only that it shares a word with, or that have wildcards."""

    def __init__(self, share: float):
        self.share = share
        self.templates: list[list[str]] = []
        self.having: dict[tuple[int, str], set[int]] = {}
        self.wild: dict[int, int] = {}

    def put(self, tokens: list[str]) -> int:
        """Put a line (or a template) into the first of the templates that agree with it in most slots, if that is a large
        enough share of them, widening its other slots; else open a new one. Wildcard slots agree with everything."""
        votes = dict(self.wild)
        for slot in enumerate(tokens):
            for t in self.having.get(slot, ()):
                votes[t] = votes.get(t, 0) + 1
        at = min(votes, key=lambda t: (-votes[t], t), default=-1)
        if at >= 0 and votes[at] >= self.share * max(1, len(tokens)):
            own = self.templates[at]
            for k, (a, b) in enumerate(zip(own, tokens)):
                if a != b and a != WILD:
                    self.having[k, a].discard(at)
                    self.wild[at] = self.wild.get(at, 0) + 1
                    own[k] = WILD
            return at
        at = len(self.templates)
        self.templates.append(list(tokens))
        for k, w in enumerate(tokens):
            if w == WILD:
                self.wild[at] = self.wild.get(at, 0) + 1
            else:
                self.having.setdefault((k, w), set()).add(at)
        return at


def _scan(depth: int, with_text: bool):
    def scan(batches):
        import re

        import pyarrow as pa
        import xxhash

        h = lambda s: xxhash.xxh64_intdigest(s) - 2**63
        digits, ends = re.compile(r"\d+"), re.compile(r"^[\W_]+|[\W_]+$")
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            seen = set()
            for doc, site, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not with_text:
                    for o, v in zip(out, (doc, site, 0, None, None, None)):
                        o.append(v)
                for no, line in enumerate((body or "").split("\n"), 1):
                    key = ends.sub("", " ".join(digits.sub("0", line.lower()).split()))
                    if not key:
                        continue
                    kh = h(key)
                    if with_text:
                        if (site, kh) in seen:
                            continue
                        seen.add((site, kh))
                    for o, v in zip(out, (doc, site, no, h(tree_path(key.split(" "), depth)), kh, key)):
                        o.append(v)
            types = (b.schema.field(0).type, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            names = ["doc", "site", "line_no", "leaf", "key", "text"]
            keep = range(1, 6) if with_text else range(5)
            cols = [i for i in keep if not (with_text and i == 2)]
            yield pa.RecordBatch.from_arrays([pa.array(out[i], types[i]) for i in cols], names=[names[i] for i in cols])

    return scan


def _local_templates(share: float):
    def local(batches):
        """One tree per partition; its leaves' templates are given out at the end, with the lines they hold."""
        import pyarrow as pa

        leaves: dict[tuple, tuple[Leaf, dict]] = {}
        for b in batches:
            for site, leaf, key, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                trees, held = leaves.setdefault((site, leaf), (Leaf(share), {}))
                if key not in held:
                    held[key] = trees.put(text.split(" "))
        rows = [(s, lf, k, " ".join(t.templates[at])) for (s, lf), (t, held) in leaves.items() for k, at in held.items()]
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(4)], names=["site", "leaf", "key", "local"])

    return local


def _merge_templates(share: float):
    def merge(pdf):
        import pandas as pd

        merged = Leaf(share)
        at = [merged.put(t.split(" ")) for t in pdf["local"]]
        return pd.DataFrame({"site": pdf["site"], "leaf": pdf["leaf"], "local": pdf["local"], "template": [" ".join(merged.templates[k]) for k in at]})

    def sorted_merge(pdf):
        # the same trees whatever the order of arrival: the widest templates first
        wide = pdf["local"].map(lambda t: -t.split(" ").count(WILD))
        return merge(pdf.assign(w=wide).sort_values(["w", "local"], kind="stable").drop(columns="w"))

    return sorted_merge


def mine_lines(docs: DataFrame, id_col: str = "docweb_id", url_col: str = "url", body_col: str = "body", min_share: float = 0.1, min_docs: int = 5, depth: int = 2, slot_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(lines, templates) of line wording that an excessive share of a site's documents carry.

    `templates`: (site, template, docs, site_docs), mined through fixed-depth token trees. `lines`: (id, line_no, site, docs),
    after an exact check: the line's own wording (see line_key) is in at least min_share and min_docs of the site's documents.

    1. One pass over the bodies writes a table of hashes: document, site, line number, leaf of the tree, wording.
    2. Leaves are counted by distinct documents. A leaf below both bounds can hold no template above them, so it is cut off;
       that loses nothing, as every document of a template is one of its leaf.
    3. Each partition parses the distinct lines of the leaves left into its own tree: a line joins the template that agrees in
       at least slot_share of the slots, others become wildcards. The trees are merged leaf by leaf, over templates only.
    4. Templates, then wordings, are counted by distinct documents; counts are combined before each shuffle.

    The site is the host of the URL in lower case; documents without URL form a site of their own (null), those without id
    are left out. Null and empty bodies have no lines but count as documents. Repeated rows count once. Empty in, empty out."""
    host = F.nullif(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(host, F.lit("")).alias("site"), F.col(body_col).alias("body"))
    id_type = dict(rows.dtypes)["doc"]
    spots = materialise(rows.mapInArrow(_scan(depth, False), f"doc {id_type}, site string, line_no int, leaf long, key long"), "lines")
    sites = spots.where("line_no = 0").groupBy("site").agg(F.count_distinct("doc").alias("site_docs"))
    lines = spots.where("line_no > 0")

    def frequent(counts: DataFrame) -> DataFrame:
        enough = counts.where(F.col("docs") >= min_docs).join(sites, "site")
        return enough.where(F.col("docs") >= F.col("site_docs") * min_share - 1e-9)

    of_leaf = ["site", "leaf"]
    of_key = [*of_leaf, "key"]
    total = spots.count()

    def wide(right: DataFrame, keys: list[str]) -> DataFrame:
        """Lines of the keys of `right`, which says in `n` how many there are: by broadcast if these are few, else without
        gathering the lines of any one key, such as a notice on all pages of a site, in one task."""
        return lines.join(small(right), keys) if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else skew_join(lines, right, keys, "n", total)

    leaves = materialise(frequent(lines.groupBy(*of_leaf).agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("n"))).select(*of_leaf, "n"), "leaves")
    texts = rows.mapInArrow(_scan(depth, True), "site string, leaf long, key long, text string").join(small(leaves), of_leaf, "left_semi").select("site", "leaf", "key", "text")
    local = materialise(texts.mapInArrow(_local_templates(slot_share), "site string, leaf long, key long, local string"), "local")
    merged = local.select("site", "leaf", "local").distinct().groupBy(*of_leaf).applyInPandas(_merge_templates(slot_share), "site string, leaf long, local string, template string")
    of_local = materialise(merged.withColumn("tid", F.xxhash64("site", "leaf", "template")), "merged")
    kept = materialise(wide(leaves, of_leaf).groupBy(*of_key).agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("n")), "counted")
    wordings = materialise(local.join(of_local, ["site", "leaf", "local"]).groupBy(*of_key).agg(F.min("tid").alias("tid")).join(kept, of_key), "wordings")
    held = wide(wordings.select(*of_key, "tid", "n"), of_key)
    broad = materialise(frequent(held.groupBy("site", "tid").agg(F.count_distinct("doc").alias("docs"))), "templates")
    templates = of_local.groupBy("site", "tid").agg(F.min("template").alias("template")).join(broad, ["site", "tid"]).select("site", "template", "docs", "site_docs")
    repeated = materialise(frequent(wordings.join(small(broad.select("site", "tid")), ["site", "tid"], "left_semi")).select(*of_key, "docs", "n"), "repeated")
    found = wide(repeated, of_key).select(F.col("doc").alias(id_col), "line_no", "site", "docs").distinct()
    return found, templates


def without_lines(docs: DataFrame, lines: DataFrame, id_col: str = "docweb_id", body_col: str = "body") -> DataFrame:
    """`docs` with the lines of `lines` (id, line_no) taken out of each body, in a column `clean_body`; other columns stay.

    A body all of whose lines go becomes empty; a null body stays null. An id's line numbers fit all of its rows only if
    these are repeats of each other, as they are here."""
    gone = lines.groupBy(F.col(id_col).alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    kept = F.filter(F.split(F.col(body_col), "\n", -1), lambda x, i: ~F.array_contains("__gone", (i + 1).cast("int")))
    joined = docs.join(gone, F.col(id_col) == F.col("__id"), "left")
    return joined.withColumn("clean_body", F.when(F.col("__gone").isNull(), F.col(body_col)).otherwise(F.array_join(kept, "\n"))).drop("__id", "__gone")
