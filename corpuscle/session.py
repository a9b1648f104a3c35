"""Session factory, tables cut from their lineage, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Tables of at most this many rows, counted beforehand, may be broadcast.
BROADCAST_ROWS = 100_000


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpuscle")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary
    folder of its own; on a cluster that is an error."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        app = spark.sparkContext
        if not app.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = _own_dirs.setdefault(app.applicationId, "") or tempfile.mkdtemp(prefix="corpuscle-")
        _own_dirs[app.applicationId] = own
    return own.rstrip("/")


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as parquet below the shared folder and read it back: a cut of the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that nothing reads any more."""
    path = getattr(df, "_table_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df, a scan, over all cores if it has fewer partitions than these (a table of few row groups), before steps that need much CPU."""
    n = df.sparkSession.sparkContext.defaultParallelism
    scan = "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    return df.repartition(n) if scan and df.rdd.getNumPartitions() < n else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it has at most so many rows; otherwise unmarked."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], rows_of_key: str, total: int) -> DataFrame:
    """Inner join with a table of unique keys, where `rows_of_key` says how many rows of `left` have the key.

    Keys with more than total/HOT_SHARE rows - at most HOT_SHARE of them, whatever the data - are broadcast, so their
    rows stay where they are; all others are joined by a shuffle in which no key exceeds that share.
    """
    hot = F.col(rows_of_key) > max(1, total // HOT_SHARE)
    heavy, light = F.broadcast(right.where(hot)), right.where(~hot)
    return left.join(heavy, keys).unionByName(left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(light, keys))


def pairs_within(rows: DataFrame, keys: list[str], id_col: str = "id", extra: list[str] = (), cell: int = 2000) -> DataFrame:
    """(a, b, <extra>a, <extra>b), a < b: pairs of rows with equal keys, for keys that many rows may share.

    A key of more than `cell` rows is cut into g groups by a hash of the id, and these are joined group by group, so that one
    task holds at most two groups, whatever share of the rows a key has."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / cell).cast("int").alias("g")).where("g > 1")
    total = rows.count()
    hot = sizes if total <= cell else materialise(sizes, "hot")
    # a hot key has more than `cell` rows; up to BROADCAST_ROWS of them are broadcast
    cut = rows.join(small(hot), keys, "left").withColumn("g", F.coalesce("g", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(id_col), F.col("g")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    side = lambda k, mine, other: cut.select(*keys, F.col("own").alias(mine), every.alias(other), F.col(id_col).alias(k), *(F.col(c).alias(f"{c}{k}") for c in extra))
    return side("a", "i", "j").join(side("b", "j", "i"), [*keys, "i", "j"]).where("a < b").select("a", "b", *(f"{c}{k}" for k in "ab" for c in extra))
