"""Listing items as a stream, merged into the crawl's state batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators.state import STATE_SCHEMA, upsert_listing

#: Parts of the state, by a hash of the id; a batch rewrites only those that its items fall into.
BUCKETS = 64
#: Versions of the state that readers may still be reading; older files go.
KEEP = 3


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _versions(spark: SparkSession, path: str) -> list[int]:
    p, fs = _fs(spark, f"{path}/versions")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p)) if fs.exists(p) else []


def _folders(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Which version's files each bucket has in this version of the state."""
    if version < 0:
        return {}
    p, fs = _fs(spark, f"{path}/versions/{version}.json")
    stream = fs.open(p)
    try:
        return {int(k): v for k, v in json.loads(bytes(stream.readAllBytes()).decode()).items()}
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: int, folders: dict[int, int]) -> None:
    draft, fs = _fs(spark, f"{path}/drafts/{version}.json")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(folders).encode()))
    finally:
        out.close()
    target, _ = _fs(spark, f"{path}/versions/{version}.json")
    fs.mkdirs(target.getParent())
    fs.rename(draft, target)


def _expire(spark: SparkSession, path: str) -> None:
    old = _versions(spark, path)
    used = {(v, k) for version in old[-KEEP:] for k, v in _folders(spark, path, version).items()}
    for version in old[:-KEEP]:
        for k, v in _folders(spark, path, version).items():
            if (v, k) not in used:
                p, fs = _fs(spark, f"{path}/data/v={v}/bucket={k}")
                fs.delete(p, True)
        p, fs = _fs(spark, f"{path}/versions/{version}.json")
        fs.delete(p, False)


def _read(spark: SparkSession, path: str, folders: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
    there = [f"{path}/data/v={v}/bucket={k}" for k, v in sorted(folders.items()) if buckets is None or k in buckets]
    return spark.read.schema(STATE_SCHEMA).parquet(*there) if there else spark.createDataFrame([], STATE_SCHEMA)


def current(spark: SparkSession, path: str) -> DataFrame:
    newest = max(_versions(spark, path), default=-1)
    return _read(spark, path, _folders(spark, path, newest))


def upsert_stream(items: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start merging a stream of listing items into the state at `path`; gives the query.

    The state lies in BUCKETS parts. Each batch reads and rewrites only the parts that its items fall into, and then publishes, by a
    rename, a version that says which files are the state. A batch that is run again after a failure finds its version there, or
    starts from the one before it, so nothing is merged twice."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = max(_versions(spark, path), default=-1)
        if newest >= batch_id:
            return
        bucket = F.pmod(F.xxhash64("docweb_id"), F.lit(BUCKETS)).cast("int")
        touched = [r[0] for r in batch.where("docweb_id is not null").select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
        folders = _folders(spark, path, newest)
        if touched:
            at = batch.agg(F.max("seen_at")).first()[0] if "seen_at" in batch.columns else None
            merged = upsert_listing(_read(spark, path, folders, touched), batch, at).withColumn("bucket", bucket)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={batch_id}")
        _publish(spark, path, batch_id, folders | dict.fromkeys(touched, batch_id))
        _expire(spark, path)

    writer = items.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
