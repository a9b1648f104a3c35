import datetime as dt
import random

from corpuscle.operators.incremental import ChangeFeed, IncrementalProcessor, replay

LOG = "docweb_id long, fetch_status int, fetched_at timestamp, raw_sha256 string, written_at timestamp, key string, at int, version int, commit int, begin int, seq int"
RUNS = "run_id long, started_at timestamp, finished_at timestamp, status string"
T0 = dt.datetime(2024, 1, 1)
day = lambda x: None if x is None else T0 + dt.timedelta(days=x)


def log(spark, rows):
    return spark.createDataFrame([(k, s, day(f), h, day(w), "x", 1, 2, 3, 4, 5) for k, s, f, h, w in rows], LOG)


def runs(spark, rows):
    return spark.createDataFrame([(i, day(a), day(a), s) for i, a, s in rows], RUNS)


def brute(rows, rs):
    done, out = {}, set()
    for i, a, s in sorted(rs, key=lambda r: (r[1], r[0])):
        if s != "ok":
            continue
        for k in {r[0] for r in rows if r[0] is not None}:
            seen = [r for r in rows if r[0] == k and r[2] is not None and r[4] is not None and r[4] < a]
            if not seen:
                continue
            last = max(seen, key=lambda r: r[2])
            if last[1] == 200 and last[3] is not None and done.get(k) != last[3]:
                out.add((i, k))
                done[k] = last[3]
    return out


def history(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(150):
        k, f = rnd.choice([1, 1, 1, 1, *range(2, 12), None]), rnd.choice([None, *(x / 7 for x in range(200))])
        s = None if f is None else (200 if hash((seed, k, f)) % 4 else 404)
        h = f"h{hash((k, f)) % 3}" if s == 200 else None
        rows.append((k, s, f, h, None if rnd.random() < 0.02 else (f or 0) + rnd.choice([0, 0, 0, 1, 9, 20])))
    rows += rows[:30]
    rs = [(i, i * 1.7 + 0.01, rnd.choice(["ok", "ok", "failed", None, "running"])) for i in range(1, 20)]
    return rows, rs


def test_replay_against_brute_force(spark):
    for seed in range(3):
        rows, rs = history(seed)
        got = replay(log(spark, rows), runs(spark, rs)).select("run_id", "docweb_id").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, rs)


def test_live_runs_find_what_the_replay_finds(spark, tmp_path):
    rows, rs = history(7)
    want, got = brute(rows, rs), set()
    table = log(spark, rows)
    for i, a, s in rs:
        p = IncrementalProcessor(spark, str(tmp_path / "ledger"))
        found = p.pending(table, day(a)).cache()
        if s != "ok":  # crashed after writing, before the marker
            found.write.mode("overwrite").parquet(str(tmp_path / f"ledger/ledger/{i}"))
            continue
        got |= {(i, r.key) for r in found.collect()}
        p.commit(i, day(a), found)
        p.commit(i, day(a), found)
    assert got == want


def test_empty_tables(spark):
    assert replay(log(spark, []), runs(spark, [(1, 1, "ok")])).count() == 0
    assert replay(log(spark, [(1, 200, 0, "a", 0)]), runs(spark, [])).count() == 0
    assert replay(log(spark, [(1, 200, 0, "a", 0)]), runs(spark, [(1, 1, None)])).count() == 0


def test_a_page_restored_to_an_old_version_is_processed_again(spark):
    rows = [(1, 200, 0, "a", 0), (1, 200, 2, "b", 2), (1, 404, 4, None, 4), (1, 200, 6, "a", 6), (1, 200, 8, "a", 8)]
    got = replay(log(spark, rows), runs(spark, [(i, 2 * i - 1, "ok") for i in range(1, 6)]), ChangeFeed()).collect()
    assert {r.run_id for r in got} == {1, 2, 4}


def test_a_compacted_ledger_holds_the_same(spark, tmp_path):
    rows, rs = history(11)
    want, got = brute(rows, rs), set()
    table = log(spark, rows)
    for i, a, s in rs:
        p = IncrementalProcessor(spark, str(tmp_path / "l"), compact_every=3)
        if s == "ok":
            found = p.pending(table, day(a)).cache()
            got |= {(i, r.key) for r in found.collect()}
            p.commit(i, day(a), found)
    assert got == want and len(p._base()[1]) >= 3 and len(p.runs()) == sum(s == "ok" for _, _, s in rs)


def test_low_marks_against_brute_force():
    import numpy as np
    import pyarrow as pa

    from corpuscle.operators.incremental import _low_marks

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 300):
        starts = np.sort(rng.integers(0, 1000, n))
        begin = rng.integers(0, 1000, 200)
        commit = begin + rng.integers(0, 300, 200)
        batch = pa.RecordBatch.from_arrays([pa.array(begin), pa.array(commit)], names=["begin", "commit"])
        got = {i: x for b in _low_marks(starts)([batch]) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        open_at = {i: begin[(begin < s) & (commit >= s)] for i, s in enumerate(starts)}
        assert got == {i: int(x.min()) for i, x in open_at.items() if len(x)}


def test_twenty_thousand_runs(spark):
    import time

    rnd = random.Random(1)
    rows = [(k, 200, f, f"h{rnd.randrange(3)}", f + rnd.choice([0, 0, 0.01, 5])) for k, f in ((rnd.randrange(200), rnd.random() * 200) for _ in range(3000))]
    table, took = log(spark, rows).cache(), {}
    for n in (80, 20_000):
        t = time.perf_counter()
        assert replay(table, runs(spark, [(i, 205 * (i + 1) / n, "ok") for i in range(n)])).count() > 1000
        took[n] = time.perf_counter() - t
    assert took[20_000] < 4 * took[80] + 5, took


def test_marks_reach_the_scan(spark, tmp_path):
    rows, _ = history(2)
    log(spark, rows).write.parquet(str(tmp_path / "log"))
    plan = ChangeFeed().rows(spark.read.parquet(str(tmp_path / "log")), day(5), day(3))._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "LessThan(written_at" in pushed and "GreaterThanOrEqual(fetched_at" in pushed
