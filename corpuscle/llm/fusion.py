"""One ranking out of several scores that differ in scale: percentiles, normal scores, weighted mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import HOT_SHARE, materialise, skew_join


def inverse_normal(p: Column) -> Column:
    """Quantile function of the standard normal distribution, by Acklam's rational approximation (error below 1.2e-9)."""
    # fixed values: coefficients of the published approximation
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(cs: tuple, x: Column) -> Column:
        out = F.lit(cs[0])
        for k in cs[1:]:
            out = out * x + F.lit(k)
        return out

    q, low = p - 0.5, F.least(p, 1 - p)
    tail = F.sqrt(-2 * F.log(low))
    out = poly(c, tail) / poly(d, tail)
    return F.when(low < 0.02425, F.when(p < 0.5, out).otherwise(-out)).otherwise(poly(a, q * q) * q / poly(b, q * q))


def value_ranks(rows: DataFrame, groups: list[str], value: str, hot_rows: int = 100_000, cuts: int = 255) -> DataFrame:
    """Per group and distinct value: `ties` (rows with the value), `higher` (rows above it) and `of` (rows of the group).

    Equal values are combined before the shuffle. Groups of more than hot_rows rows and of more than a thousandth of all
    rows (so at most a thousand of them, which are broadcast) are cut into value ranges at approximate quantiles; each
    range is ranked by its own task, and the rows in higher ranges are added. No group is sorted by one task."""
    ties = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("ties"))
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count("*").alias("of"))
    total = rows.count()
    limit = max(hot_rows, total // HOT_SHARE)
    if total > limit and sizes.where(F.col("of") > limit).limit(1).count():
        hot = sizes.where(F.col("of") > limit).select(*groups)
        bounds = rows.where(F.col(value).isNotNull()).join(F.broadcast(hot), groups).groupBy(*groups).agg(F.percentile_approx(value, [(i + 1) / (cuts + 1) for i in range(cuts)], 10 * cuts).alias("cuts"))
        ties = ties.join(F.broadcast(bounds), groups, "left")
        ties = ties.withColumn("part", F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col(value))), F.lit(0))).drop("cuts")
    else:
        ties = ties.withColumn("part", F.lit(0))
    inside = Window.partitionBy(*groups, "part").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*groups).orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = ties.groupBy(*groups, "part").agg(F.sum("ties").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).withColumn("of", F.sum("n").over(Window.partitionBy(*groups))).drop("n")
    ranked = ties.withColumn("higher", F.coalesce(F.sum("ties").over(inside), F.lit(0)))
    return ranked.join(parts, [*groups, "part"]).select(*groups, value, "ties", (F.col("higher") + F.col("before")).alias("higher"), "of")


def tie_order(rows: DataFrame, keys: list[str], item: str, ties: str, total: int, hot_rows: int, cuts: int = 255) -> DataFrame:
    """`rows` with `nth`, from 1: the place of `item` among the rows with equal `keys`, of which there are `ties`.

    Keys of more than hot_rows rows and of more than a thousandth of all rows (so at most a thousand of them) are cut into
    ranges of items at the quantiles of at most about a million of them, chosen by hash; each range is sorted by its own task
    and the rows in lower ranges are added."""
    limit = max(hot_rows, total // HOT_SHARE)
    hot = rows.where(F.col(ties) > limit)
    n_hot = hot.count() if total > limit else 0
    if not n_hot:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(item)))
    some = hot.where(F.pmod(F.xxhash64(item), F.lit(max(1, n_hot // 1_000_000))) == 0)
    every = F.sort_array(F.collect_set(item))
    step = F.size("s") / (cuts + 1)
    bounds = some.groupBy(*keys).agg(every.alias("s")).select(*keys, F.transform(F.sequence(F.lit(1), F.lit(cuts)), lambda k: F.get("s", F.floor(k * step).cast("int"))).alias("cuts"))
    cut = rows.join(F.broadcast(bounds), keys, "left").withColumn("part", F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col(item))), F.lit(0))).drop("cuts")
    cut = materialise(cut, "ties")
    lower = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.where(F.col(ties) > limit).groupBy(*keys, "part").agg(F.count("*").alias("n")).withColumn("lower", F.coalesce(F.sum("n").over(lower), F.lit(0))).drop("n")  # at most a thousand keys x cuts
    nth = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(item)) + F.coalesce("lower", F.lit(0))
    return cut.join(F.broadcast(parts), [*keys, "part"], "left").withColumn("nth", nth).drop("part", "lower")


def fuse_scores(rows: DataFrame, group: str, item: str, weights: dict[str, float], hot_rows: int = 100_000) -> DataFrame:
    """(group, item, <score>..., <score>_higher..., fused, position): one ranking per group out of the columns in `weights`.

    Within the group, each score becomes its empirical percentile with averaged ties, (rows below + half the ties) / rows,
    then the normal score of that percentile; `fused` is the weighted mean of those, to twelve places (so that the order of
    summation breaks no tie), and `position` counts from 1 by fused descending, item ascending. `<score>_higher` is the
    number of other items of the group with a strictly higher score.

    A missing score (null or NaN) ranks nothing and is left out of the item's mean; an item without any score has a null
    fused value and comes last. Rows that repeat (group, item) count once, each score by its greatest value. Rows with a
    null group or item are left out. A group of one item, or with only equal scores, gets 0. Empty in, empty out."""
    names = list(weights)
    clean = [F.max(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c) for c in names]
    base = materialise(rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(group).alias("g"), F.col(item).alias("i")).agg(*clean), "scores")
    long = base.select("g", "i", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(names)))).alias("x")).select("g", "i", "x.*").where("value is not null")
    ranks = value_ranks(long, ["g", "kind"], "value", hot_rows).withColumn("z", inverse_normal((F.col("of") - F.col("higher") - F.col("ties") / 2) / F.col("of")))
    wide = skew_join(long, ranks, ["g", "kind", "value"], "ties", long.count())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights.values())), F.col("kind") + 1)
    per = [F.max(F.when(F.col("kind") == k, F.col("value"))).alias(c) for k, c in enumerate(names)] + [F.max(F.when(F.col("kind") == k, F.col("higher"))).alias(f"{c}_higher") for k, c in enumerate(names)]
    scored = wide.groupBy("g", "i").agg(*per, F.round(F.sum(F.col("z") * weight) / F.sum(weight), 12).alias("fused"))
    bare = base.where(" and ".join(f"`{c}` is null" for c in names)).select("g", "i", *names, *(F.lit(None).cast("long").alias(f"{c}_higher") for c in names), F.lit(None).cast("double").alias("fused"))
    every = materialise(scored.unionByName(bare).withColumn("f", F.coalesce("fused", F.lit(float("-inf")))), "fused")
    total = base.count()
    order = skew_join(every, value_ranks(every.select("g", "f"), ["g"], "f", hot_rows).drop("of"), ["g", "f"], "ties", total)
    order = tie_order(order, ["g", "f"], "i", "ties", total, hot_rows)
    return order.select(F.col("g").alias(group), F.col("i").alias(item), *names, *(f"{c}_higher" for c in names), "fused", (F.col("nth") + F.col("higher")).cast("long").alias("position"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null if either is null or all zero or their lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def score_hits(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, closeness, lexical, weight) of every hit: closeness is the cosine of the two embeddings.

    Repeated chunks and queries count once (greatest vector, greatest weight), so hits are not multiplied; hits on unknown
    chunks or queries keep their lexical score only."""
    c = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max("weight").alias("weight"), F.max("embedding").alias("cv"))
    q = queries.where("query_id is not null").groupBy("query_id").agg(F.max("embedding").alias("qv"))
    h = hits.select("query_id", "chunk_id", "lexical").groupBy("query_id", "chunk_id").agg(F.max("lexical").alias("lexical"))
    return h.join(c, "chunk_id", "left").join(q, "query_id", "left").select("query_id", "chunk_id", cosine(F.col("cv"), F.col("qv")).alias("closeness"), "lexical", "weight")
