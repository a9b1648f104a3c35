"""Mixing sources to target weights: soft memberships, rates by projected gradient, and whole records for the rates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import materialise, small

#: Labelled records on which the classifier is fitted, chosen by hash; all else covers every record.
FIT_ROWS = 6_000
#: Sources of a mixture; the driver holds a few numbers for each.
MAX_SOURCES = 20_000
BUCKETS = 1 << 14
#: fixed value: the pattern with which this public vocabulary cuts text before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_name(c):
    """Sources are the same without regard to letter case and blanks around them; empty counts as none."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def features(text: str) -> np.ndarray:
    """Hashed counts of the words of a text: (bucket, count) pairs."""
    import re
    import zlib
    from collections import Counter

    n = Counter(re.findall(r"[^\W\d_]+", text.lower()))
    return np.array([(zlib.crc32(w.encode()) % BUCKETS, c) for w, c in n.items()], np.int64).reshape(-1, 2)


def fit_classifier(sample: list[tuple[str, str]], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial naive Bayes on labelled texts: log probabilities of buckets by source, and of the sources."""
    at = {s: i for i, s in enumerate(names)}
    counts = np.full((len(names), BUCKETS), 0.05)
    prior = np.ones(len(names))
    for source, text in sample:
        if source in at and text:
            f = features(text)
            np.add.at(counts[at[source]], f[:, 0], f[:, 1])
            prior[at[source]] += 1
    return (np.log(counts) - np.log(counts.sum(1, keepdims=True))).astype(np.float32), np.log(prior / prior.sum())


def measure(docs: DataFrame, id_col: str, text_col: str, source_col: str, names: list[str], model: tuple, tokenizer: str) -> DataFrame:
    """(id, source, tokens, soft): tokens of the whole text; soft is the posterior over `names` where the source is unknown."""
    weights, prior = model

    def run(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)
        for b in batches:
            ids, texts, sources = (b.column(i).to_pylist() for i in range(3))
            tokens = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            soft = []
            for t, s in zip(texts, sources):
                if s is not None or not t or not names:
                    soft.append(None)
                    continue
                f = features(t)
                ll = prior + (weights[:, f[:, 0]] * np.sqrt(f[:, 1])).sum(1)
                p = np.exp(ll - ll.max())
                soft.append((p / p.sum()).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tokens, pa.int64()), pa.array(soft, pa.list_(pa.float64()))], names=["id", "source", "tokens", "soft"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), source_name(F.col(source_col)).alias("source"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, source string, tokens long, soft array<double>")


def _fold(history: np.ndarray, caps: np.ndarray) -> callable:
    """Rates of soft records after the steps so far. history: steps x mixes x sources; caps: mixes x sources."""

    def rates(p: np.ndarray) -> np.ndarray:
        cap = caps[:, p.argmax(1)]
        r = np.zeros(cap.shape)
        for g in history:
            r = np.clip(r - g @ p.T, 0, cap)
        return r

    return rates


def fit_rates(table: DataFrame, names: list[str], targets: np.ndarray, caps: np.ndarray, rounds: int = 40, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Nonnegative rates whose expected tokens per source come closest to the targets (mixes x sources), by least squares.

    Records with a known source all follow the same steps, so each source is one cell, of its tokens' sum; records of
    unknown source have rates of their own. Each round is one distributed sum over those (expected tokens by source) and a
    projected gradient step, scaled by the source's tokens; what a record's rate is follows from the steps alone, so no
    state is kept or lost. Gives (rates by source: mixes x sources, steps: rounds x mixes x sources)."""
    at = {s: i for i, s in enumerate(names)}
    hard = np.zeros(len(names))
    for r in table.where("soft is null and source is not null").groupBy("source").agg(F.sum("tokens").alias("n")).collect():
        if r.source in at:
            hard[at[r.source]] = r.n
    soft = table.where("soft is not null and tokens > 0").select("tokens", "soft")
    any_soft = soft.limit(1).count() > 0
    rate = np.zeros_like(targets)
    history: list[np.ndarray] = []
    total = None
    for _ in range(rounds):
        expected = rate * hard
        if any_soft:
            fold = _fold(np.array(history).reshape(-1, *targets.shape), caps)

            def sums(batches, fold=fold, first=total is None):
                import pyarrow as pa

                out = np.zeros((targets.shape[0] + 1, targets.shape[1]))
                for b in batches:
                    if not b.num_rows:
                        continue
                    p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    tok = b.column(0).to_numpy().astype(float)
                    out[:-1] += (fold(p) * tok) @ p
                    out[-1] += tok @ p
                i, j = np.nonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(out[i, j])], names=["i", "j", "x"])

            both = np.zeros((targets.shape[0] + 1, targets.shape[1]))
            for r in soft.mapInArrow(sums, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
                both[r.i, r.j] = r.x
            expected, total = expected + both[:-1], hard + both[-1]
        else:
            total = hard
        step = (expected - targets) / np.maximum(total, 1)
        moved = np.clip(rate - step, 0, caps)
        done = np.abs(moved - rate).max(initial=0) < tolerance
        history.append(step)
        rate = moved
        if done:
            break
    return rate, np.array(history).reshape(-1, *targets.shape)


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, tokenizer: str, fit_rows: int = FIT_ROWS, buckets: int = 256) -> tuple[DataFrame, DataFrame]:
    """(records, report) for each mix of `targets` (mix_id, source, target_share, max_repeats, total_share_of_corpus).

    records: (mix_id, id, source, tokens, copies), copies >= 1 and never above max_repeats of the source. report: one row per
    mix and source, of target_tokens, target_share, actual_tokens, actual_share (of the mix as it came out), records, copies,
    most_copies, reach_tokens (what the source gives at most, at max_repeats) and feasible_size (of the mix: the largest size at which
    every source that has records can keep its share; above it, sources fall short and the shares of others are larger).

    Tokens are those of the public tokenizer at `tokenizer`. A record of known source belongs to it wholly, so all records of
    a source have one rate. A record of unknown source gets posteriors from a classifier fitted on at most fit_rows labelled
    records, a rate of its own from the fit, and is used and reported under the likeliest source. A rate r becomes floor(r) copies
    and, for the rest, one more with that probability (unknown source; by hash), or for the records that come first in
    an order by hash until their tokens reach the rest (known source). The latter are asked for what the former left open, so the
    tokens of a source are met to within half a record and the fractions of unknown ones, unless max_repeats binds. Sums run
    per hash bucket, so no source, however large, is sorted in one task.

    A target without records stays unmet and is reported with 0; sources without target are not used; where max_repeats
    doesn't suffice, the source falls short. Null shares count as 0, null max_repeats as 1. Null and empty texts have no tokens
    and are never chosen. Empty tables give empty results, but for the report's rows of unmet targets."""
    spark, id_type = docs.sparkSession, dict(docs.dtypes)[id_col]
    mix_type = dict(targets.dtypes)["mix_id"]
    asked = targets.where("mix_id is not null").groupBy("mix_id", source_name(F.col("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"), F.max("total_share_of_corpus").alias("size"))
    wanted = asked.where("source is not null")
    if wanted.select("source").distinct().limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    listed = sorted(wanted.collect(), key=lambda r: (r.mix_id, r.source))
    if not listed:
        records = spark.createDataFrame([], f"mix_id {mix_type}, `{id_col}` {id_type}, source string, tokens long, copies int")
        return records, spark.createDataFrame([], f"mix_id {mix_type}, source string, target_share double, target_tokens long, reach_tokens long, feasible_size long, actual_tokens long, records long, copies long, most_copies int, actual_share double")
    labelled = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), source_name(F.col(source_col)).alias("source")).where("source is not null and text is not null")
    per_source = {r.source: r["count"] for r in labelled.groupBy("source").count().limit(MAX_SOURCES + 1).collect()}
    names = sorted({r.source for r in listed} | set(per_source))
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    every = max(1, sum(per_source.values()) // max(1, 2 * fit_rows))  # about twice what is wanted, so that the order decides, not the file
    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(fit_rows)
    sample = [(r.source, r.text) for r in chosen.select("source", "text").collect()]
    table = materialise(measure(docs, id_col, text_col, source_col, names, fit_classifier(sample, names), tokenizer), "measured")
    mixes = sorted({r.mix_id for r in listed})
    at, of = {m: i for i, m in enumerate(mixes)}, {s: i for i, s in enumerate(names)}
    corpus = int(table.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    goal, caps = np.zeros((len(mixes), len(names))), np.zeros((len(mixes), len(names)))
    for r in listed:
        goal[at[r.mix_id], of[r.source]] = r.share * (r["size"] or 0) * corpus
        caps[at[r.mix_id], of[r.source]] = max(0, r.cap)
    rate, history = fit_rates(table, names, goal, caps)
    fold = _fold(history, caps)

    def soft_rates(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            p = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            r = fold(p)
            m = len(mixes)
            idx = pa.array(np.repeat(np.arange(b.num_rows), m))
            yield pa.RecordBatch.from_arrays([pa.array(mixes * b.num_rows, mix_arrow), b.column(0).take(idx), pa.array([names[i] for i in np.repeat(p.argmax(1), m)], pa.string()), b.column(1).take(idx), pa.array(r.T.ravel())], names=["mix_id", "id", "source", "tokens", "rate"])

    import pyarrow as pa

    mix_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[mix_type]
    draw = F.pmod(F.xxhash64("id", "mix_id"), F.lit(1_000_000)) / 1e6
    loose = table.where("soft is not null and tokens > 0").select("id", "tokens", "soft").mapInArrow(soft_rates, f"mix_id {mix_type}, id {id_type}, source string, tokens long, rate double")
    loose = loose.select("mix_id", "id", "source", "tokens", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int").alias("copies"))
    loose = materialise(loose.where("copies > 0"), "loose")
    # what the records of unknown source came to, as whole records under their likeliest source, the others make up for
    hard, came = np.zeros(len(names)), np.zeros_like(goal)
    for r in table.where("soft is null and source is not null").groupBy("source").agg(F.sum("tokens").alias("n")).collect():
        hard[of[r.source]] = r.n
    for r in loose.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect():
        came[at[r.mix_id], of[r.source]] = r.n
    rate = np.clip((goal - came) / np.maximum(hard, 1), 0, caps)
    cells = spark.createDataFrame([(m, s, float(rate[at[m], of[s]])) for m in mixes for s in names if rate[at[m], of[s]] > 0], f"mix_id {mix_type}, source string, rate double")
    known = table.where("soft is null and source is not null and tokens > 0").withColumn("h", F.xxhash64("id")).withColumn("part", F.pmod("h", F.lit(buckets)))
    sums = known.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("source"))).drop("n")
    inside = Window.partitionBy("source", "part").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("here", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(small(before), ["source", "part"])
    rest = (F.col("rate") - F.floor("rate")) * F.col("all")
    more = F.when(F.col("before") + F.col("here") + F.col("tokens") / 2 <= rest, 1).otherwise(0)
    firm = placed.join(small(cells), "source").select("mix_id", "id", "source", "tokens", (F.floor("rate") + more).cast("int").alias("copies"))
    records = materialise(firm.unionByName(loose).where("copies > 0"), "mixed")
    got = records.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("records"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    soft_tokens = np.zeros(len(names))
    for r in table.where("soft is not null").groupBy(F.get(F.array(*map(F.lit, names)), F.expr("array_position(soft, array_max(soft)) - 1").cast("int")).alias("source")).agg(F.sum("tokens").alias("n")).collect():
        soft_tokens[of[r.source]] += r.n
    reach = caps * (hard + soft_tokens)
    share = np.zeros_like(goal)
    for r in listed:
        share[at[r.mix_id], of[r.source]] = r.share
    feasible = {m: min((reach[i, k] / share[i, k] for k in range(len(names)) if share[i, k] > 0 and reach[i, k] > 0), default=0.0) for m, i in at.items()}
    want = [(r.mix_id, r.source, float(r.share), int(round(goal[at[r.mix_id], of[r.source]])), int(reach[at[r.mix_id], of[r.source]]), int(feasible[r.mix_id])) for r in listed]
    want = spark.createDataFrame(want, f"mix_id {mix_type}, source string, target_share double, target_tokens long, reach_tokens long, feasible_size long")
    report = want.join(got, ["mix_id", "source"], "left").fillna(0, ["actual_tokens", "records", "copies", "most_copies"])
    size = F.sum("actual_tokens").over(Window.partitionBy("mix_id"))
    report = report.withColumn("actual_share", F.when(size > 0, F.col("actual_tokens") / size).otherwise(0.0))
    return records.withColumnRenamed("id", id_col), report
