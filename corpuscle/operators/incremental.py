"""Processing only new or changed records, exactly once each, although rows arrive late and runs fail.

A record's write is a transaction: it begins at `begin` (here: the fetch) and is visible from `commit` on (here: the row's
arrival). A run must not simply read on from the last run's start, for a transaction that was open then may commit later
with an older `begin`. So every run rereads from the oldest transaction that was open when the last successful run started,
and an anti-join of (key, version) pairs with the ledger of what successful runs processed takes the overlap out again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.session import materialise

#: The replay takes the list of successful runs to the driver, at most so many (8 bytes of time and id each).
MAX_RUNS = 20_000


@dataclass(frozen=True)
class ChangeFeed:
    """How to read versions off a log table; `good` is the SQL condition under which a latest row is processed at all."""

    key: str = "docweb_id"
    version: str = "raw_sha256"
    begin: str = "fetched_at"
    commit: str = "written_at"
    good: str = "fetch_status = 200"

    def rows(self, log: DataFrame, visible_before=None, since=None) -> DataFrame:
        """One row per key and write, at its first arrival; rows without key, begin or commit carry no write.

        Log rows repeated under new ids collapse here, before anything is shuffled by key alone. Only writes that arrived before
        `visible_before` and neither began nor arrived before `since` are read; both tests reach the scan. (Of a repeated row that may
        leave a later copy, which a ledger knows.)"""
        if visible_before is not None:
            log = log.where(F.col(self.commit) < visible_before)
        if since is not None:
            log = log.where((F.col(self.begin) >= since) & (F.col(self.commit) >= since))
        return (
            log.where(" and ".join(f"`{c}` is not null" for c in (self.key, self.begin, self.commit)))
            .select(
                F.col(self.key).alias("key"),
                F.col(self.begin).alias("at"),
                F.when(F.coalesce(F.expr(self.good), F.lit(False)), F.col(self.version)).alias("version"),
                F.col(self.commit).alias("commit"),
            )
            .groupBy("key", "at", "version")
            .agg(F.min("commit").alias("commit"))
            .withColumn("begin", F.least("at", "commit"))
        )


def _newest(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key the write with the greatest `at`; if several share it, the greatest version (null lowest)."""
    return rows.groupBy(*keys).agg(F.max(F.struct("at", "version")).alias("s")).select(*keys, F.col("s.version").alias("version"), F.col("s.at").alias("at"))


def _low_marks(starts):
    """Per batch of (begin, commit): for each run the oldest write that was open at its start.

    A write is open at a stretch of runs. Each stretch is covered by two blocks whose length is a power of two, and the blocks'
    minima are handed down level by level, so the work doesn't grow with the length of stretches."""
    import numpy as np

    never = np.iinfo(np.int64).max

    def marks(batches):
        import pyarrow as pa

        levels = [np.full(len(starts), never, np.int64) for _ in range(max(1, len(starts).bit_length()))]
        for b in batches:
            begin, commit = (b.column(c).to_numpy() for c in range(2))
            lo, hi = np.searchsorted(starts, begin, "right"), np.searchsorted(starts, commit, "right")
            open_ = hi > lo
            lo, hi, begin = lo[open_], hi[open_], begin[open_]
            k = np.frexp((hi - lo).astype(float))[1] - 1
            for level in np.unique(k):
                own = k == level
                for at in (lo[own], hi[own] - (1 << level)):
                    np.minimum.at(levels[level], at, begin[own])
        for level in range(len(levels) - 1, 0, -1):
            half, upper, lower = 1 << (level - 1), levels[level], levels[level - 1]
            np.minimum(lower, upper, out=lower)
            np.minimum(lower[half:], upper[: len(upper) - half], out=lower[half:])
        seen = np.flatnonzero(levels[0] < never)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(levels[0][seen])], names=["seq", "low"])

    return marks


def _first_runs(starts, low):
    """Adds to each write the first run that sees it, and drops it if that run doesn't read so far back."""
    import numpy as np

    def place(batches):
        import pyarrow as pa

        for b in batches:
            begin, commit = b.column(3).to_numpy(), b.column(4).to_numpy()
            seq = np.searchsorted(starts, commit, "right")
            seen = seq < len(starts)
            seen[seen] = begin[seen] >= low[seq[seen]]
            out = pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(seq.astype(np.int32))], names=["key", "at", "version", "seq"])
            yield out.filter(pa.array(seen))

    return place


def replay(log: DataFrame, runs: DataFrame, feed: ChangeFeed = ChangeFeed(), run_id: str = "run_id", started: str = "started_at", status: str = "status") -> DataFrame:
    """What each successful run of a history processes: (run_id, key, version), as one plan over all runs.

    Runs whose status isn't 'ok' left nothing behind. A run rereads from its low-water mark, the oldest write that was open at
    the last run's start. For a key of which no write has become visible since that run, everything reread is in the ledger
    and falls to the anti-join, so only runs that see a key's write first are formed for it: the key's version there is that of
    its newest write up to then, and the pair is dropped if the ledger's entry for the key, the latest before the run, has the
    same version. Writes find their run by a binary search in the starts; rows per key in the last step are bounded by the
    number of runs, whatever share of the log a key holds. Empty tables give an empty result."""
    import numpy as np

    spark = log.sparkSession
    ok = runs.where((F.col(status) == "ok") & F.col(started).isNotNull()).select(F.col(run_id).alias("run_id"), F.col(started).alias("started")).distinct()
    listed = ok.withColumn("started", F.expr("unix_micros(started)")).orderBy("started", "run_id").limit(MAX_RUNS + 1).collect()
    if len(listed) > MAX_RUNS:
        raise ValueError(f"more than {MAX_RUNS} runs: replay them in several calls")
    key_type, version_type, run_type = dict(log.dtypes)[feed.key], dict(log.dtypes)[feed.version], dict(runs.dtypes)[run_id]
    if not listed:
        return spark.createDataFrame([], f"run_id {run_type}, `{feed.key}` {key_type}, version {version_type}")
    rows = materialise(feed.rows(log).withColumns({c: F.expr(f"unix_micros(`{c}`)") for c in ("at", "begin", "commit")}).select("key", "at", "version", "begin", "commit"), "writes")
    starts = np.array([r.started for r in listed], np.int64)
    # the oldest write open at each start: at most one row a run reaches the driver
    oldest = {r.seq: r.low for r in rows.select("begin", "commit").mapInArrow(_low_marks(starts), "seq int, low long").groupBy("seq").agg(F.min("low").alias("low")).collect()}
    low = np.array([-(2**62), *(min(oldest.get(i, listed[i].started), listed[i].started) for i in range(len(listed) - 1))], np.int64)
    seen = rows.mapInArrow(_first_runs(starts, low), f"key {key_type}, at long, version {version_type}, seq int")
    news = seen.groupBy("key", "seq").agg(F.max(F.struct("at", "version")).alias("s"))
    upto = Window.partitionBy("key").orderBy("seq")
    states = news.select("key", "seq", F.max("s").over(upto).alias("s")).select("key", "seq", F.col("s.version").alias("version")).where("version is not null")
    states = states.withColumn("ledger_seq", F.lag("seq").over(upto))
    ledger = states.select("key", "version", F.col("seq").alias("ledger_seq"))
    todo = states.join(ledger, ["key", "version", "ledger_seq"], "left_anti")
    ids = spark.createDataFrame([(i, r.run_id) for i, r in enumerate(listed)], f"seq int, run_id {run_type}")
    return todo.join(F.broadcast(ids), "seq").select("run_id", F.col("key").alias(feed.key), "version")  # ids: at most MAX_RUNS rows


class IncrementalProcessor:
    """The same method for live runs, with a ledger on shared storage.

    `pending` gives the pairs a run has to process, `commit` records them. The ledger's part of a run is written first and
    counts only once the run's marker file exists, which appears by a rename: a run that dies in between leaves nothing
    behind, and its successor rereads the same range. `commit` may be called again after a crash with the same run id."""

    def __init__(self, spark: SparkSession, path: str, feed: ChangeFeed = ChangeFeed(), compact_every: int = 50):
        self.spark, self.path, self.feed, self.compact_every = spark, path.rstrip("/"), feed, compact_every

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _read(self, path: str):
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, what, path: str) -> None:
        """Write a small file that is there as a whole or not at all."""
        draft, fs = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(what).encode()))
        finally:
            out.close()
        target, _ = self._fs(path)
        fs.mkdirs(target.getParent())
        if not fs.rename(draft, target):
            raise RuntimeError(f"{path} could not be written")

    def _base(self) -> tuple[str | None, list[dict]]:
        """The newest compacted ledger, and the runs in it."""
        done = [n for n in self._names("base") if n.endswith(".json")]
        newest = max(done, key=lambda n: int(n.split(".")[0]), default=None)
        return (None, []) if newest is None else (f"{self.path}/base/{newest[:-5]}", self._read(f"{self.path}/base/{newest}"))

    def runs(self) -> list[dict]:
        """Committed runs in order of start; of those that are compacted no file is opened."""
        known = self._base()[1]
        names = {str(r["run_id"]) for r in known}
        found = known + [self._read(f"{self.path}/committed/{n}") for n in self._names("committed") if n not in names]
        return sorted(found, key=lambda r: (r["started"], str(r["run_id"])))

    def ledger(self) -> DataFrame | None:
        """The version with which each key was most recently processed: (key, version, started)."""
        base, inside = self._base()
        names = {str(r["run_id"]) for r in inside}
        parts = [f"{self.path}/ledger/{r['run_id']}" for r in self.runs() if str(r["run_id"]) not in names]
        every = ([base] if base else []) + parts
        if not every:
            return None
        newest = F.max(F.struct("started", "version")).alias("s")
        return self.spark.read.parquet(*every).groupBy("key").agg(newest).select("key", "s.version", "s.started")

    def compact(self) -> None:
        """Put the ledger's parts together. The new ledger counts once its list of runs is there; a crash before leaves the old."""
        done = self.runs()
        whole = self.ledger()
        if whole is None:
            return
        n = len(done)
        whole.write.mode("overwrite").parquet(f"{self.path}/base/{n}")
        self._publish(done, f"{self.path}/base/{n}.json")

    def pending(self, log: DataFrame, started) -> DataFrame:
        """(key, version) pairs new or changed for a run that starts at `started` (a timestamp).

        Read are only writes from the low-water mark on: the oldest write that was open when the last committed run started."""
        done, since = self.runs(), None
        if done:
            last = F.timestamp_micros(F.lit(done[-1]["started"]))
            open_ = log.where((F.col(self.feed.commit) >= last) & (F.col(self.feed.commit) < F.lit(started)) & (F.col(self.feed.begin) < last))
            low = open_.agg(F.min(self.feed.begin)).first()[0]
            since = last if low is None else F.least(F.lit(low), last)
        rows = self.feed.rows(log, F.lit(started), since)
        found = _newest(rows, "key").where("version is not null").select("key", "version")
        ledger = self.ledger()
        return found.join(ledger, ["key", "version"], "left_anti") if ledger is not None else found

    def commit(self, run_id, started, processed: DataFrame) -> None:
        """Record the pairs of a finished run, all or nothing."""
        done = self.runs()
        if any(str(r["run_id"]) == str(run_id) for r in done):
            return
        micros = self.spark.range(1).select(F.unix_micros(F.lit(started))).first()[0]
        processed.select("key", "version", F.lit(micros).alias("started")).write.mode("overwrite").parquet(f"{self.path}/ledger/{run_id}")
        self._publish({"run_id": run_id, "started": micros}, f"{self.path}/committed/{run_id}")
        if len(done) + 1 - len(self._base()[1]) >= self.compact_every:
            self.compact()
