"""Connected components by alternating stars: edges are rewired until every vertex hangs on its component's minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import discard, materialise, skew_join


#: So many edges fit into one task.
ONE_TASK = 200_000


def _joined(batches):
    """Union-find over all edges of the partition: every vertex with the least of its component, but for that itself."""
    import pyarrow as pa

    above: dict = {}

    def root(x):
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    types = (pa.int64(), pa.int64())
    for b in batches:
        types = (b.schema.field(0).type, b.schema.field(1).type)
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            u, v = root(u), root(v)
            above[max(u, v)] = min(u, v)
    rows = [(x, r) for x in list(above) if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], types[0]), pa.array([r for _, r in rows], types[1])], names=["u", "v"])


def _of_vertices(vertices: DataFrame, e: DataFrame) -> DataFrame:
    return vertices.select("id").distinct().join(e.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 50, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): for every id of `vertices`, the smallest id it is connected with by `edges` (src, dst).

    Large star: every neighbour greater than v is joined to the minimum of v's neighbourhood. Small star: every
    neighbour not greater, likewise. Either keeps the components and pulls vertices towards the minimum. Edges of a vertex with
    more than a thousandth of all edges are not gathered: its minimum, computed with map-side combining, is broadcast.
    Up to `one_task` edges, counted, are joined by a union-find in one task instead, which saves the rounds. Null ends and self loops link nothing; repeats are harmless; a vertex without edges is its own component."""
    e = materialise(edges.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    mark = _mark(e)
    if mark[0] <= one_task:
        e = e.coalesce(1).mapInArrow(_joined, f"u {dict(e.dtypes)['u']}, v {dict(e.dtypes)['v']}")
        return _of_vertices(vertices, e)
    for _ in range(max_rounds):
        both = e.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("x")).select("x.*")
        large = _star(both, "b > a", mark[0] * 2)
        down = materialise(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        small = _star(down, "true", mark[0] * 2)
        new = materialise(small.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
        discard(down)
        discard(e)
        e, before, mark = new, mark, _mark(new)
        if mark == before:
            return _of_vertices(vertices, e)
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def _star(pairs: DataFrame, which: str, total: int) -> DataFrame:
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    joined = skew_join(pairs, least, ["a"], "n", total)
    moved = joined.where(which).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved if which != "true" else moved.unionByName(least.select("a", F.col("m").alias("b")))


def _mark(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(r[0]), int(r[1])
