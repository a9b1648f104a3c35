"""Most similar vectors for every vector: inverted lists scanned with adaptive dimension sampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.session import materialise, skew_join

#: Vectors taken to the driver to place centres, and vectors a centre is placed by in the workers; all else covers all vectors.
TRAIN_ROWS = 20_000
ROWS_PER_CENTRE = 30
#: Up to so many lists their centres are placed on the driver; beyond, only those of groups of lists.
FLAT_LISTS = 1024
#: Lists looked through for a vector are the square root of the number of lists, at least this many (recall: see README).
MIN_PROBES = 8


def probes_for(lists: int) -> int:
    """How many of so many lists are looked through for a vector."""
    return min(lists, max(MIN_PROBES, math.isqrt(lists - 1) + 1))


def lists_for(n: int, list_rows: int) -> int:
    """Number of lists for n vectors: one for list_rows of them, but no more than four times the root of n, so that what
    every worker holds (the centres) and the rows of a list both grow with the root only."""
    return max(1, min(n // list_rows, 4 * math.isqrt(n)))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix; after it, any few dimensions are a fair sample of a vector."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on unit vectors; a centre that loses all its vectors keeps its place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def adaptive_scan(q: np.ndarray, x: np.ndarray, k: int, block: int, eps: float, radius: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, squared distance) of at most k nearest rows of x for each row of q, within `radius` (squared).

    Columns come in blocks. After d of D dimensions a candidate is abandoned if its partial distance exceeds
    radius * d/D * (1 + eps/sqrt(d))^2: were its whole distance within the radius, a partial one so large would be
    improbable, as the dimensions are rotated at random. Only the first block is computed for all pairs."""
    n, dim = x.shape
    out_q, out_x, out_d = [], [], []
    radius = np.broadcast_to(np.asarray(radius, dtype=np.float32), (len(q),))
    step = max(1, 4_000_000 // max(1, n))
    x0 = x[:, :block]
    x0n = np.einsum("ij,ij->i", x0, x0)
    for s in range(0, len(q), step):
        qs, rs = q[s : s + step], radius[s : s + step].copy()
        if n > k:  # k whole distances bound the k-th nearest
            probe = x[np.linspace(0, n - 1, min(n, max(4 * k, 32))).astype(int)]
            full = np.maximum(0, np.einsum("ij,ij->i", qs, qs)[:, None] + np.einsum("ij,ij->i", probe, probe) - 2 * qs @ probe.T)
            rs = np.minimum(rs, np.partition(full, k, axis=1)[:, k] * 1.0001 + 1e-6)
        part = np.einsum("ij,ij->i", qs[:, :block], qs[:, :block])[:, None] + x0n - 2 * qs[:, :block] @ x0.T
        d = block
        qi, xi = np.nonzero(part <= (rs * (d / dim) * (1 + eps / d**0.5) ** 2)[:, None] + 1e-5)
        dist = np.maximum(part[qi, xi], 0)
        while d < dim and len(qi):
            w = slice(d, min(dim, d + block))
            diff = qs[qi, w] - x[xi, w]
            dist = dist + np.einsum("ij,ij->i", diff, diff)
            d = w.stop
            keep = dist <= rs[qi] * ((d / dim) * (1 + eps / d**0.5) ** 2 if d < dim else 1) + 1e-5
            qi, xi, dist = qi[keep], xi[keep], dist[keep]
        order = np.lexsort((xi, dist, qi))
        qi, xi, dist = qi[order], xi[order], dist[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        top = place < k
        out_q.append(qi[top] + s)
        out_x.append(xi[top])
        out_d.append(dist[top])
    cat = lambda a, t: np.concatenate(a).astype(t) if a else np.zeros(0, t)
    return cat(out_q, np.int64), cat(out_x, np.int64), cat(out_d, np.float64)


def unit_classes(rows: DataFrame, id_col: str, vec_col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(reps, members): equal vectors share one representative, the smallest id. reps: (id, v); members: (id, rep).

    Vectors that are null, of another length, all zero or not finite are left out, and rows with a null id; an id that
    repeats counts once, by its greatest vector."""
    good = F.col(id_col).isNotNull() & (F.size(vec_col) == dim) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists(vec_col, lambda x: x != 0)
    one = materialise(rows.where(good).groupBy(F.col(id_col).alias("id")).agg(F.max(vec_col).alias("v")), "vectors")
    reps = materialise(one.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "reps")
    # only what has copies is joined; a vector that a large share of the rows has is joined where these are
    many = reps.where("copies > 1").select(F.xxhash64("v").alias("h"), F.col("id").alias("rep"), F.col("v").alias("rv"), "copies")
    copied = skew_join(one.withColumn("h", F.xxhash64("v")), many, ["h"], "copies", one.count()).where("v = rv").select("id", "rep")
    return reps.select("id", "v"), reps.where("copies = 1").select("id", F.col("id").alias("rep")).unionByName(copied)


def _unit(v: np.ndarray, rot: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return ((v / np.linalg.norm(v, axis=1, keepdims=True)) @ rot).astype(np.float32)


def place_centres(reps: DataFrame, n: int, lists: int, dim: int, rot: np.ndarray, seed: int, flat_lists: int) -> np.ndarray:
    """Centres of so many lists, by spherical k-means on vectors chosen by hash: on at most TRAIN_ROWS of them on the driver, or,
    for more than flat_lists lists, in two levels. Then the driver places groups of lists only, and each group's centres
    are placed in a task of its own, as many as its share of the vectors, on ROWS_PER_CENTRE vectors for each."""
    every = max(1, n // TRAIN_ROWS)
    chosen = reps.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    train = np.array([r.v for r in chosen.select("v").collect()], dtype=np.float64).reshape(-1, dim)
    train = _unit(train if len(train) else np.eye(dim)[:1], rot)
    if lists <= flat_lists:
        return centres(train, min(lists, len(train)), seed)
    coarse = centres(train, min(math.isqrt(lists), len(train)), seed)

    def group(batches):
        import pyarrow as pa

        for b in batches:
            v = _unit(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64), rot) if b.num_rows else np.zeros((0, dim), np.float32)
            yield pa.RecordBatch.from_arrays([pa.array((v @ coarse.T).argmax(1).astype(np.int32)), pa.array([r.tobytes() for r in v], pa.binary())], names=["g", "vec"])

    rate = max(1, n // (ROWS_PER_CENTRE * lists))

    def place(key, tab):
        import pyarrow as pa

        v = np.frombuffer(b"".join(tab.column("vec").to_pylist()), np.float32).reshape(-1, dim)
        c = centres(v, max(1, min(len(v), round(len(v) * rate * lists / n))), seed)
        return pa.table({"vec": pa.array([r.astype(np.float32).tobytes() for r in c], pa.binary())})

    some = reps.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rate)) == 0).select("v")
    found = some.mapInArrow(group, "g int, vec binary").groupBy("g").applyInArrow(place, "vec binary").collect()  # about `lists` rows
    return np.frombuffer(b"".join(sorted(bytes(r.vec) for r in found)), np.float32).reshape(-1, dim)


def nearest(reps: DataFrame, k: int = 10, dim: int = 64, min_cosine: float | None = None, probes: int | None = None, list_rows: int = 400, block: int = 16, eps: float = 2.1, cell_rows: int = 8192, seed: int = 7, flat_lists: int = FLAT_LISTS) -> DataFrame:
    """(id, other, cosine): for every row of reps (id, v) its k nearest other rows, nearest first, approximately.

    Lists: as many as lists_for() says, around the centres of place_centres(), which are placed on vectors chosen by hash; all
    vectors are then put into the list of their nearest centre, and looked for in `probes` lists, by default as many as
    probes_for() says, which grow with the lists. Lists larger than cell_rows are cut into cells on the side searched
    and on the side asked, so a list that holds a third of all vectors is spread over many tasks, and each task holds at
    most two cells. Inside, see adaptive_scan. Accuracy is measured against brute force in the tests. With min_cosine only
    rows at least so similar are given, and abandoned earlier."""
    spark, id_type = reps.sparkSession, dict(reps.dtypes)["id"]
    reps = materialise(reps, "reps")
    n = reps.count()
    schema = f"id {id_type}, other {id_type}, cosine double"
    if n < 2:
        return spark.createDataFrame([], schema)
    rot = rotation(dim, seed)
    cent = place_centres(reps, n, lists_for(n, list_rows), dim, rot, seed, flat_lists)
    lists = len(cent)
    np_probes = probes_for(lists) if probes is None else min(probes, lists)

    def assign(batches):
        import pyarrow as pa

        rows = max(1, 40_000 // np_probes)  # a vector becomes np_probes rows
        for b in (b.slice(s, rows) for b in batches for s in range(0, b.num_rows, rows)):
            v = _unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64), rot)
            near = v @ cent.T
            top = np.argpartition(-near, np_probes - 1, axis=1)[:, :np_probes]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
            at = np.repeat(np.arange(len(v)), np_probes)
            vec = pa.array([r.tobytes() for r in v[at]], pa.binary())
            home = np.tile(np.arange(np_probes) == 0, len(v))
            yield pa.RecordBatch.from_arrays([pa.array(top.ravel().astype(np.int32)), b.column(0).take(pa.array(at)), vec, pa.array(home)], names=["list", "id", "vec", "home"])

    placed = materialise(reps.select("id", "v").mapInArrow(assign, f"list int, id {id_type}, vec binary, home boolean"), "placed")
    # one row per list, see lists_for()
    sizes = placed.groupBy("list").agg(F.ceil(F.count_if("home") / cell_rows).cast("int").alias("nd"), F.ceil(F.count("*") / cell_rows).cast("int").alias("nq"))
    h = F.xxhash64("id")
    wide = placed.join(F.broadcast(sizes.withColumn("nd", F.greatest("nd", F.lit(1)))), "list")
    wide = wide.withColumn("hd", F.pmod(h, F.col("nd")).cast("int")).withColumn("hq", F.pmod(h, F.col("nq")).cast("int"))
    cell = lambda d, q: F.struct(d.alias("d"), q.alias("q"))
    as_query = F.transform(F.sequence(F.lit(0), F.col("nd") - 1), lambda d: cell(d, F.col("hq")))
    as_data = F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: cell(F.col("hd"), q))
    cells = wide.withColumn("c", F.explode(F.when(F.col("home"), F.array_union(as_query, as_data)).otherwise(as_query)))
    cells = cells.select("list", F.col("c.d").alias("d"), F.col("c.q").alias("q"), "id", "vec", (F.col("home") & (F.col("c.d") == F.col("hd"))).alias("data"), (F.col("c.q") == F.col("hq")).alias("ask"))
    radius = 8.0 if min_cosine is None else 2 - 2 * min_cosine

    def scan(tab):
        import pyarrow as pa

        tab = tab.combine_chunks()
        v = np.frombuffer(b"".join(tab.column("vec").to_pylist()), np.float32).reshape(-1, dim)
        data, ask = (np.flatnonzero(tab.column(c).to_numpy(zero_copy_only=False)) for c in ("data", "ask"))
        ids = tab.column("id").combine_chunks()
        qi, xi, dist = adaptive_scan(v[ask], v[data], k + 1, block, eps, radius + 1e-5)
        qi, xi = ask[qi], data[xi]
        keep = qi != xi
        qi, xi = qi[keep], xi[keep]
        cos = np.einsum("ij,ij->i", v[qi].astype(np.float64), v[xi].astype(np.float64))
        return pa.Table.from_arrays([ids.take(pa.array(qi)), ids.take(pa.array(xi)), pa.array(cos)], names=["id", "other", "cosine"])

    got = cells.groupBy("list", "d", "q").applyInArrow(scan, schema)
    # a row is found in one list only (its home), so there are no repeats; at most k per list and cell compete
    w = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    best = got if min_cosine is None else got.where(F.col("cosine") >= min_cosine)
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def nearest_of_members(members: DataFrame, near: DataFrame) -> DataFrame:
    """(id, rep, other, cosine): for every row of members (id, rep) what nearest() gave for its representative.

    `other` is a representative again; the ids with equal vectors are those with the same rep. An id whose representative has
    no neighbour keeps one row, with nulls. Representatives of many ids are joined where these are."""
    members = materialise(members, "members")
    lists = near.groupBy(F.col("id").alias("rep")).agg(F.collect_list(F.struct("other", "cosine")).alias("near"))
    of_rep = materialise(members.groupBy("rep").agg(F.count("*").alias("copies")).join(lists, "rep", "left"), "near")
    return skew_join(members, of_rep, ["rep"], "copies", members.count()).select("id", "rep", F.explode_outer("near").alias("n")).select("id", "rep", "n.other", "n.cosine")


def similar_pairs(rows: DataFrame, id_col: str, vec_col: str, min_cosine: float, k: int = 10, dim: int = 64, **kw) -> DataFrame:
    """(a, b, cosine): pairs of different ids, a < b, among each id's k nearest with at least min_cosine, from either side.

    Equal vectors are searched once, by their representative; what it finds holds for all of its copies, and copies are
    paired with each other (cosine 1)."""
    reps, members = unit_classes(rows, id_col, vec_col, dim)
    members = materialise(members, "members")
    near = nearest(reps, k, dim, min_cosine, **kw).select(F.least("id", "other").alias("ra"), F.greatest("id", "other").alias("rb"), "cosine").groupBy("ra", "rb").agg(F.max("cosine").alias("cosine"))
    a, b = members.select(F.col("rep").alias("ra"), F.col("id").alias("x")), members.select(F.col("rep").alias("rb"), F.col("id").alias("y"))
    across = near.join(a, "ra").join(b, "rb").select("x", "y", "cosine")
    copies = a.join(b, F.col("ra") == F.col("rb")).where("x < y").select("x", "y", F.lit(1.0).alias("cosine"))
    return across.unionByName(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine").distinct()
