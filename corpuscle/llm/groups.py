"""Pairwise matches consolidated into groups: Hash-to-Min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import discard, materialise, skew_join


def match_groups(pairs: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, group_id): every id of a pair, with the smallest id that it is linked with directly or through others.

    Each vertex holds a cluster set, at first itself and its neighbours, kept as rows (v, u) so that no set has to fit
    anywhere. In a round, v sends its whole set to the set's minimum, and the minimum to all of the set:
    (v, u) with minimum m becomes (m, u) and (u, m). Rounds end when nothing changes, after a number logarithmic in the
    longest chain. Minima are combined before the shuffle; a vertex holding more than a thousandth of all rows (the
    minimum of a giant group) gets its minimum by a broadcast of at most a thousand rows. Every round is written to the
    shared folder, so a lost executor costs a part of one round only.

    Pairs with a null on either side link nothing; repeated, reversed and self pairs are harmless (an id only paired with
    itself is a group of one); other columns are ignored; an empty table gives an empty result."""
    e = pairs.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null").distinct()
    ways = F.explode(F.array(*(F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x, y in (("v", "u"), ("u", "v"), ("v", "v"), ("u", "u"))))).alias("w")
    state = materialise(e.select(ways).select("w.*").distinct(), "groups")
    total, mark = _fingerprint(state)
    for _ in range(max_rounds):
        least = materialise(state.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), "minima")
        told = skew_join(state, least, ["v"], "n", total)
        sent = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("w")
        new = materialise(told.select(sent).select("w.*").distinct(), "groups")
        discard(least)
        discard(state)
        state = new
        now = _fingerprint(state)
        if now == (total, mark):
            break
        total, mark = now
    else:
        raise RuntimeError(f"groups not stable after {max_rounds} rounds")
    return state.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("group_id"))


def _fingerprint(state: DataFrame) -> tuple[int, int]:
    r = state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(r[0]), int(r[1])
