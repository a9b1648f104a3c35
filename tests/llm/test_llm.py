"""Every operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import math
import random
import re

from collections import defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from compare import SF, same
from pyspark.sql import functions as F

from corpuscle.llm import contamination, distinctive, fusion, groups, mixing, near_duplicates, neighbours, repeated_lines, truncation
from corpuscle.llm.queries import QUERIES, SQL, TOKENIZER
from corpuscle.sources.tables import table

CLASH = ["id", "text", "key", "v", "u", "m", "n", "g", "i", "value", "kind", "doc", "site", "line_no", "leaf", "list", "home", "rep", "sig", "a", "b", "item", "tokens", "soft", "w", "t", "tri", "tail"]


def clash(df):
    return df.withColumns({c: F.lit(1) for c in CLASH if c not in df.columns})


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, QUERIES, SQL, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


# ------------------------------------------------------------------------------------------------------ 2 terms


def test_terms(spark):
    rows = [("a", "Caffè CAFFÈ uno2due _tre_"), ("a", "Caffè CAFFÈ uno2due _tre_"), ("b", "caffè"), ("c", None), ("d", ""), (None, "caffè"), ("e", "parola " * 50_000)]
    df = clash(spark.createDataFrame(rows, "cid string, txt string"))
    got = {(r.id, r.term): r for r in distinctive.term_scores(df, "cid", "txt").collect()}
    assert set(got) == {("a", "caffè"), ("a", "uno"), ("a", "due"), ("a", "tre"), ("b", "caffè"), ("e", "parola")}
    r, avg = got["a", "caffè"], (5 + 1 + 50_000) / 5
    assert (r.tf, r.df) == (2, 2) and r.score == pytest.approx(math.log1p(3.5 / 2.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 5 / avg)))
    assert distinctive.term_scores(df.limit(0), "cid", "txt").count() == 0
    assert distinctive.term_scores(df.where("cid = 'c'"), "cid", "txt").count() == 0


# ----------------------------------------------------------------------------------------------------- 3 fusion


def test_inverse_normal(spark):
    ps = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 0.999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(fusion.inverse_normal(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-8)


@pytest.mark.parametrize("hot_rows", [100_000, 7])
def test_fusion_against_brute_force(spark, hot_rows):
    rnd = random.Random(5)
    rows = [(q, f"c{i}", rnd.choice([None, 0.0, 0.0, rnd.random() * 10**q, float("nan")]), rnd.choice([None, 1.0, rnd.random()])) for q in range(4) for i in range(30 if q else 90)]
    rows += [*rows[:9], (None, "c1", 1.0, 1.0), (1, None, 1.0, 1.0), (9, "x", 5.0, None), (8, "y", None, None)]
    df = spark.createDataFrame(rows, "q int, c string, x double, y double").withColumns({k: F.lit(3) for k in ("g", "i", "kind", "value", "z", "ties", "part")})
    got = {(r.q, r.c): r for r in fusion.fuse_scores(df, "q", "c", {"x": 2.0, "y": 1.0}, hot_rows).collect()}
    clean = {(q, c): (None if x is None or x != x else x, y) for q, c, x, y in rows if q is not None and c is not None}
    assert set(got) == set(clean)
    for q in {k[0] for k in clean}:
        own = {k: v for k, v in clean.items() if k[0] == q}
        fused = {}
        for k, v in own.items():
            z = []
            for at, w in ((0, 2.0), (1, 1.0)):
                if v[at] is not None:
                    every = [o[at] for o in own.values() if o[at] is not None]
                    p = (sum(o < v[at] for o in every) + every.count(v[at]) / 2) / len(every)
                    z.append((NormalDist().inv_cdf(p), w))
                    assert got[k]["x_higher" if at == 0 else "y_higher"] == sum(o > v[at] for o in every)
            fused[k] = sum(a * b for a, b in z) / sum(b for _, b in z) if z else None
            assert got[k].fused == (pytest.approx(fused[k], abs=1e-7) if z else None)
        order = sorted(own, key=lambda k: (-got[k].fused if got[k].fused is not None else math.inf, k[1]))
        assert [got[k].position for k in order] == list(range(1, len(order) + 1))
    assert fusion.fuse_scores(df.limit(0), "q", "c", {"x": 1.0}).count() == 0


def test_hits_score(spark):
    ch = spark.createDataFrame([("a", 1.0, [1.0, 0.0]), ("a", 1.0, [1.0, 0.0]), ("b", None, [0.0, 0.0]), ("c", 2.0, [1.0]), ("d", 2.0, None)], "chunk_id string, weight double, embedding array<float>")
    qs = spark.createDataFrame([(1, [3.0, 4.0])], "query_id long, embedding array<float>")
    hs = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (1, "b", 1.0), (1, "c", None), (1, "d", 0.0), (1, "e", 1.0), (2, "a", 1.0)], "query_id long, chunk_id string, lexical double")
    got = {(r.query_id, r.chunk_id): r.closeness for r in fusion.score_hits(hs, ch, qs).collect()}
    assert got == {(1, "a"): pytest.approx(0.6), (1, "b"): None, (1, "c"): None, (1, "d"): None, (1, "e"): None, (2, "a"): None}


# ------------------------------------------------------------------------------------------------------ 4 lines


def line_rows():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefghilmnopqrstuvz", k=6))
    rows = []
    for i in range(120):
        site = "a.example" if i % 4 else "b.example"
        lines = [" ".join(word() for _ in range(rnd.randrange(3, 30))) for _ in range(5)]
        lines.insert(rnd.randrange(5), f"  Stampato  il {i}/{i % 12 + 1}/2020,\tore {i} !!")
        if i % 3 == 0:
            lines.insert(2, f"A cura della redazione {word()} numero {i}")
        if i % 20 == 0:
            lines.append("Riga abbastanza rara")
        lines += ["", "***", "- 12 -"] if i % 2 else ["\r"]
        rows.append((i, f"https://{site}:443/x/{i}", "\n".join(lines)))
    rows += rows[:6] + [(500, None, "Stampato il 1/1/2020, ore 1"), (501, "https://c.example", None), (502, "https://c.example/", ""), (None, "https://a.example", "x"), (503, "https://a.example/q", "lunga " * 60_000)]
    return rows


def test_lines_against_brute_force(spark):
    rows = line_rows()
    df = clash(spark.createDataFrame(rows, "docweb_id long, url string, body string"))
    docs, held = defaultdict(set), defaultdict(set)
    for i, u, b in rows:
        if i is None:
            continue
        site = u.split("/")[2].split(":")[0] if u else ""
        docs[site].add(i)
        for no, line in enumerate((b or "").split("\n"), 1):
            if repeated_lines.line_key(line):
                held[site, repeated_lines.line_key(line)].add((i, no))
    want = {x for (s, _), xs in held.items() if len({i for i, _ in xs}) >= max(5, 0.1 * len(docs[s])) for x in xs}
    lines, templates = repeated_lines.mine_lines(df)
    got = [(r.docweb_id, r.line_no) for r in lines.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    wide = [r for r in templates.collect() if "redazione" in r.template]
    assert wide and all("*" in r.template.split() for r in wide)  # words in one slot become a wildcard
    clean = {r.docweb_id: r.clean_body for r in repeated_lines.without_lines(df, lines).collect()}
    assert clean[501] is None and clean[502] == "" and clean[500] == "Stampato il 1/1/2020, ore 1"
    assert all("Stampato" not in (clean[i] or "") for i in range(120))
    assert repeated_lines.mine_lines(df.limit(0))[0].count() == 0


def test_keys():
    k = repeated_lines.line_key
    assert k("  «Visto  il 12/3» ") == k("VISTO il 7/44.") == "visto il 0/0" and k(" -_*\t") == "" and k("a-b") == "a-b"


# ------------------------------------------------------------------------------------------------- 5 neighbours


def vectors(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64)) + 2 * rng.standard_normal((12, 64))[rng.integers(0, 12, n)]
    near = x[:40] + 0.1 * rng.standard_normal((40, 64))
    return np.vstack([x, near, *([x[:1]] * copies)]).astype(np.float32)


@pytest.mark.parametrize("flat_lists", [1024, 4])
def test_neighbours_recall(spark, flat_lists):
    x = vectors(3000, 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = clash(spark.createDataFrame([(f"c{i:05d}", r.tolist()) for i, r in enumerate(x)], "cid string, vec array<float>"))
    reps, _ = neighbours.unit_classes(df, "cid", "vec", 64)
    got = defaultdict(list)
    for r in neighbours.nearest(reps, 10, list_rows=100, cell_rows=64, flat_lists=flat_lists).collect():
        got[int(r.id[1:])].append((r.cosine, int(r.other[1:])))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = [len({o for _, o in got[i]} & set(np.argsort(-s[i])[:10])) / 10 for i in range(0, len(x), 10)]
    assert np.mean(hits) >= 0.9, np.mean(hits)
    assert all(len(v) <= 10 and abs(c - s[i, o]) < 1e-4 for i, v in got.items() for c, o in v)


def test_neighbours_recall_on_chunks_at_defaults(spark):
    reps, _ = neighbours.unit_classes(table(spark, "/root/testdata/sf0.1", "chunks"), "chunk_id", "embedding", 64)
    rows = sorted((r.id, r.v) for r in reps.collect())
    at = {c: i for i, (c, _) in enumerate(rows)}
    u = np.array([v for _, v in rows], np.float64)
    u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
    got = defaultdict(set)
    for r in neighbours.nearest(reps, 10).collect():
        got[at[r.id]].add(at[r.other])
    asked = range(0, len(u), 5)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -2
    hits = [len(got[i] & set(np.argpartition(-x, 10)[:10].tolist())) / 10 for i, x in zip(asked, s)]
    assert np.mean(hits) >= 0.9, np.mean(hits)


def test_lists_and_probes_grow():
    assert [neighbours.lists_for(n, 400) for n in (1, 7_711, 76_293, 1_600_000, 10**8, 10**10)] == [1, 19, 190, 4000, 40_000, 400_000]
    assert [neighbours.probes_for(n) for n in (1, 5, 19, 190, 4096)] == [1, 5, 8, 14, 64]


def test_pairs_copies_and_bad_vectors(spark):
    x = vectors(400, 2, copies=3)
    bad = [("n", None), ("z", [0.0] * 64), ("h", [1.0] * 32), ("q", [float("nan")] * 64), (None, [1.0] * 64), ("o", [None] + [1.0] * 63)]
    rows = [(f"c{i:04d}", r.tolist()) for i, r in enumerate(x)] + bad + [("scaled", (x[5] * 7).tolist())]
    df = spark.createDataFrame([*rows, *rows[:5]], "cid string, vec array<float>")
    names = [f"c{i:04d}" for i in range(len(x))] + ["scaled"]
    y = np.vstack([x, x[5] * 7]).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = {tuple(sorted((names[i], names[j]))) for i, j in zip(*np.nonzero(np.triu(y @ y.T >= 0.95, 1)))}
    got = [(r.a, r.b) for r in neighbours.similar_pairs(df, "cid", "vec", 0.95).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    assert neighbours.similar_pairs(df.limit(0), "cid", "vec", 0.95).count() == 0
    assert neighbours.similar_pairs(df.limit(1), "cid", "vec", 0.95).count() == 0


def test_nearest_of_every_vector(spark, tmp_path):
    x = vectors(60, 5, copies=50)
    rows = [(f"c{i:03d}", r.tolist()) for i, r in enumerate(x)]
    for d, some in (("a", rows), ("b", rows[-50:])):
        spark.createDataFrame(some, "chunk_id string, embedding array<float>").write.parquet(f"{tmp_path}/{d}/chunks.parquet")
    got = defaultdict(list)
    for r in QUERIES["p5_nearest"](spark, f"{tmp_path}/a").collect():
        got[r.chunk_id].append((r.representative, r.similar_chunk_id, r.cosine))
    assert set(got) == {c for c, _ in rows} and all(len(set(v)) == len(v) == 10 for v in got.values())
    assert all(sorted(got[c]) == sorted(got["c000"]) and got[c][0][0] == "c000" for c, _ in rows[-50:])
    assert all(r[0] == c for c, v in got.items() if c < rows[-50][0] for r in v)
    alone = QUERIES["p5_nearest"](spark, f"{tmp_path}/b").collect()  # one class: no other vector, but every chunk is there
    assert {(r.chunk_id, r.representative, r.similar_chunk_id) for r in alone} == {(c, rows[-50][0], None) for c, _ in rows[-50:]} and len(alone) == 50


def test_abandoning_early_loses_little():
    x = vectors(2000, 3).astype(np.float64)
    x = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ neighbours.rotation(64, 7)).astype(np.float32)
    q, o, d = neighbours.adaptive_scan(x[:200], x, 10, 16, 2.1, 8.0)
    s = ((x[:200, None] - x[None]) ** 2).sum(2)
    found = np.mean([len(set(o[q == i]) & set(np.argsort(s[i], kind="stable")[:10])) / 10 for i in range(200)])
    assert found >= 0.97 and np.abs(d - s[q, o]).max() < 1e-4


# ----------------------------------------------------------------------------------------------------- 6 groups


def test_groups(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(220)] + [(i + 1, i) for i in range(1000, 1090)] + [(5000, 5000 + i) for i in range(2500)] + [(None, 1), (2, None), (None, None), (777, 777)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = clash(spark.createDataFrame(pairs + pairs[:50], "x long, y long"))
    got = groups.match_groups(df, "x", "y").collect()
    assert {r.id: r.group_id for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert groups.match_groups(df.limit(0), "x", "y").count() == 0


# --------------------------------------------------------------------------------------------- 7 near-duplicates


def texts(seed):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdeilmnorst", k=5)) for _ in range(400)]
    rows = []
    for i in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.choice([3, 9, 14, 20, 24, 30, 40, 120, 300]))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(rnd.randrange(4)):
            v = list(w)
            for _ in range(rnd.randrange(1, 3)):
                v[rnd.randrange(len(v))] = rnd.choice(vocab)
            k = rnd.randrange(len(v))
            rows.append((len(rows), " ".join(v[k:] + v[:k] if rnd.random() < 0.2 else v)))
    return rows


def sequences(t):
    w = re.findall(r"\w+", re.sub(r"\bx{2,}\b|\[omissis\]", "x", re.sub(r"\d+", "0", (t or "").lower())))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_near_duplicates_against_brute_force(spark, threshold):
    rows = texts(1)
    extra = [(900, None), (901, ""), (902, "solo"), (903, "SOLO"), (904, "due parole 12"), (905, "due parole 99"), (None, "solo"), (906, "- -"), (907, "lungo testo " * 40_000)]
    rows += extra + rows[:7]
    df = clash(spark.createDataFrame(rows, "docid long, body string"))
    s = {i: sequences(t) for i, t in rows if i is not None and sequences(t)}
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-9}
    pairs, members = near_duplicates.near_duplicates(df, "docid", "body", threshold)
    got = [(r.a, r.b) for r in near_duplicates.expand_pairs(pairs, members).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert {r.id for r in members.collect()} == set(s)
    empty = near_duplicates.near_duplicates(df.limit(0), "docid", "body", threshold)
    assert empty[0].count() == empty[1].count() == 0


def test_many_copies_of_one_text_are_one_class(spark):
    t = texts(3)[0][1] + " " + "altre parole " * 30
    df = spark.range(3000).select(F.col("id").alias("docid"), F.lit(t).alias("body"))
    pairs, members = near_duplicates.near_duplicates(df, "docid", "body")
    assert pairs.count() == 0 and members.where("rep = 0").count() == 3000


def test_boundary():
    assert near_duplicates.band_plan(0.7, 5, 1e-4) == 51 and near_duplicates.light_prefix(3, 0.7) == 2
    cost = lambda n: 51 + 5 * 51 * n / 1000
    n = near_duplicates.light_boundary(0.7, 5, 51)
    assert math.comb(near_duplicates.light_prefix(n, 0.7), 2) <= cost(n) and math.comb(near_duplicates.light_prefix(n + 1, 0.7), 2) > cost(n + 1)


def test_both_kinds_of_sets_are_found(spark):
    rows = texts(5)
    bands = near_duplicates.band_plan(0.6, 5, 1e-4)
    edge = near_duplicates.light_boundary(0.6, 5, bands)
    pairs, _ = near_duplicates.near_duplicates(spark.createDataFrame(rows, "docid long, body string"), "docid", "body", 0.6)
    sizes = {i: len(sequences(t)) for i, t in rows}
    kinds = {(sizes[r.a] <= edge, sizes[r.b] <= edge) for r in pairs.collect()}
    assert {(True, True), (False, False)} <= kinds


def test_a_text_that_repeats_an_id_counts_by_one_signature(spark):
    a, b = " ".join(f"uno{chr(97 + i % 26)}{i // 26 * 'x' or 'y'}" for i in range(60)), " ".join(f"due{chr(97 + i % 26)}{i // 26 * 'z' or 'w'}" for i in range(60))
    for docs in ([(1, a), (1, b), (2, a), (3, b)], [(3, b), (2, a), (1, b), (1, a)]):
        _, members = near_duplicates.near_duplicates(spark.createDataFrame(docs, "docid long, body string"), "docid", "body")
        assert len({frozenset((r.id, r.rep) for r in members.collect())}) == 1 and members.count() == 3


def test_words_are_hashed_once_for_many_texts(monkeypatch):
    import xxhash

    rnd, hashed, digest = random.Random(9), [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w: hashed.append(w) or digest(w))
    monkeypatch.setattr(near_duplicates, "_hashes", near_duplicates._Hashes())
    parts = ["xx", "xxx", "Xx", "x", "[omissis]", "[Omissis]", "omissis", "12", "3a4", "a12b", "\u0663\u0664", "\u00e8", "_", "x_xx", "xx0", "uno", "due", "z" * 80, "-", ".", "\n"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", " "]) for _ in range(rnd.randrange(60))) for _ in range(400)]
    plain = [re.findall(r"\w+", re.sub(r"\bx{2,}\b|\[omissis\]", "x", re.sub(r"\d+", "0", t.lower()))) for t in texts]
    for held in (200_000, 5):  # results do not depend on what is held
        monkeypatch.setattr(near_duplicates, "HELD_WORDS", held)
        near_duplicates._hashes.clear()
        got = {t: frozenset(near_duplicates._shingles(t).tolist()) for t in texts}
        assert len(near_duplicates._hashes) <= held
        own = {frozenset(sequences(t)): got[t] for t in texts}
        assert all(own[frozenset(sequences(t))] == got[t] and len(got[t]) == len(sequences(t)) for t in texts) and len(set(got.values())) == len(own)
    hashed.clear()
    long = [" ".join(rnd.choices(["uno", "due", "tre", "12", "quattro"], k=50)) for _ in range(100)]
    near_duplicates._hashes.clear()
    monkeypatch.setattr(near_duplicates, "HELD_WORDS", 200_000)
    for t in long:
        near_duplicates._shingles(t)
    assert len(hashed) == 5
    assert [near_duplicates.WORD.findall(near_duplicates.PLACEHOLDER.sub("x", re.sub(r"\d+", "0", t.lower()))) for t in texts] == plain


def test_minima_and_distinct_values():
    rng = np.random.default_rng(6)
    a, c = rng.integers(0, 2**32, (2, 70), dtype=np.uint64).astype(np.uint32)
    for n in (1, 5, 100):
        x = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        want = (x[:, None] * a + c).min(0)
        for functions, elements in ((64, 1024), (7, 3), (100, 1)):
            assert (near_duplicates.minima(x, a, c, functions, elements) == want).all()
    for x in (np.zeros(0, np.uint64), np.array([3], np.uint64), rng.integers(0, 20, 50).astype(np.uint64)):
        assert near_duplicates.distinct(x).tolist() == np.unique(x).tolist()


# ------------------------------------------------------------------------------------------------------ 8 leaks


def test_leaks_against_brute_force(spark):
    rnd = random.Random(8)
    vocab = [f"w{chr(97 + i % 26)}{i // 26}" for i in range(60)]  # few words: n-grams that are not rare
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rnd.choice([8, 12, 20, 40])))) for i in range(30)] + [(90, None), (91, ""), (92, "wa0"), (None, "x")]
    docs = []
    for d in range(150):
        w = text(rnd.randrange(0, 80))
        if rnd.random() < 0.6:
            it = items[rnd.randrange(30)][1].split()
            k = rnd.randrange(5, len(it) + 1)
            at = rnd.randrange(len(it) - k + 1)
            w[len(w) // 2 : len(w) // 2] = [x.upper() if rnd.random() < 0.3 else x for x in it[at : at + k]]
        docs.append((d, ", ".join(w)))
    docs += [(500, None), (501, ""), (None, items[5][1]), (502, "è " * 50_000 + items[3][1]), *docs[:5]]
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    dg, ig = [(d, grams(words(t))) for d, t in docs if d is not None], [(i, grams(words(t))) for i, t in items if i is not None]
    want = {(d, i) for d, x in dg for i, y in ig if x & y}
    df, its = clash(spark.createDataFrame(docs, "doc_id long, txt string")), clash(spark.createDataFrame(items, "item_id long, item_text string"))
    for block in (20_000, 7):
        got = [(r.doc, r.item) for r in contamination.leaked_items(df, its, text_col="txt", block_items=block).where("run >= 12").collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) >= 20
    assert contamination.leaked_items(df.limit(0), its, text_col="txt").count() == 0 and contamination.leaked_items(df, its.limit(0), text_col="txt").count() == 0


def test_edited_copies_are_found_by_alignment(spark):
    item = "il garante ordina alla società di cancellare i dati raccolti senza consenso entro trenta giorni dalla notifica del provvedimento presente"
    w = item.split()
    w[4], w[11], w[16] = "azienda", "detenuti", "comunicazione"
    df = spark.createDataFrame([(1, "Premesso che " + " ".join(w) + " e altro"), (2, "nulla di simile a quel testo qui")], "doc_id long, text string")
    r = contamination.leaked_items(df, spark.createDataFrame([(1, item)], "item_id long, item_text string")).collect()
    assert len(r) == 1 and r[0].doc == 1 and r[0].run < 12 and r[0].share > 0.5


def test_edited_copies_are_found_however_many_there_are(spark):
    w = [f"parola{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    item = " ".join(w)
    edited = " ".join("estranea" if i % 8 == 7 else x for i, x in enumerate(w))
    once = " ".join(["altro"] * 5 + w[:5] + w[8:13] + w[16:21] + ["altro"] * 5)  # some n-grams are in more documents than others
    docs = [(i, edited) for i in range(20)] + [(100 + i, f"testo qualunque numero {i} senza nulla") for i in range(500)] + [(1000 + i, once) for i in range(5)]
    r = contamination.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, item_text string")).collect()
    assert {x.doc for x in r} == set(range(20)) and all(x.run == 7 and x.share > 0.75 for x in r)


def test_bounds_leave_out_no_leak(spark):
    rnd = random.Random(18)
    vocab = [f"v{chr(97 + i)}" for i in range(26)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([5, 9, 14, 30])))) for i in range(12)]
    docs = [(d, " ".join(rnd.choices(vocab, k=15) + [x for x in items[d % 12][1].split() if rnd.random() < 0.85] + rnd.choices(vocab, k=15))) for d in range(120)]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    number = {w: i + 1 for i, w in enumerate(vocab)}
    code = lambda t: np.array([number[w] for w in t.split()])
    want = {}
    for d, t in docs:
        for i, x in items:
            run, share = contamination.longest_run(code(x), code(t)), contamination.align(code(x), code(t)) / (2 * len(x.split()))
            if grams(t) & grams(x) and (run >= 12 or share >= min(0.5, 30 / len(x.split()))):
                want[d, i] = (run, pytest.approx(share))
    got = contamination.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()
    assert {(r.doc, r.item): (r.run, r.share) for r in got} == want and len(want) > 60


def test_recall_of_edited_copies(spark):
    rnd = random.Random(28)
    vocab = ["".join(rnd.choices("abcdeilmnorstuv", k=rnd.randrange(2, 9))) for _ in range(3000)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(40, 120)))) for i in range(40)]

    def edited(words, rate):
        out = []
        for w in words:
            x = rnd.random()
            out += [] if x < rate / 3 else [rnd.choice(vocab)] if x < 2 * rate / 3 else [w, rnd.choice(vocab)] if x < rate else [w]
        return out

    planted, docs = {}, []
    for d in range(400):
        i, rate, whole = rnd.randrange(40), rnd.choice([0.05, 0.1, 0.15]), rnd.random() < 0.5
        w = items[i][1].split()
        part = w if whole else w[(k := rnd.randrange(len(w) - 38)) : k + max(38, len(w) // 2)]
        docs.append((d, " ".join(rnd.choices(vocab, k=100) + edited(part, rate) + rnd.choices(vocab, k=100))))
        planted[d] = (i, rate)
    got = contamination.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")).collect()
    pairs = {(r.doc, r.item) for r in got}
    for rate in (0.05, 0.1, 0.15):
        own = [d for d in planted if planted[d][1] == rate]
        assert np.mean([(d, planted[d][0]) in pairs for d in own]) >= 0.9, rate
    assert pairs <= {(d, i) for d, (i, _) in planted.items()}


def test_texts_are_judged_many_at_a_time(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(38)
    vocab = [f"v{chr(97 + i % 26)}{i // 26}" for i in range(120)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randrange(5, 90)))) for i in range(25)]
    docs = [(d, " ".join(rnd.choices(vocab, k=rnd.randrange(40)) + [x for x in items[d % 25][1].split() if rnd.random() < 0.8] + rnd.choices(vocab, k=rnd.randrange(40)))) for d in range(400)]
    docs += [(900, None), (901, ""), (902, items[3][1][: len(items[3][1]) // 2]), (903, items[3][1][len(items[3][1]) // 2 :])]  # runs do not go on into the next text
    seeds, calls, compare = contamination.Seeds(items, 5), [], contamination.compare
    monkeypatch.setattr(contamination, "compare", lambda a, b: calls.append(len(a)) or compare(a, b))
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc", "text"])
    found = []
    for cells, chars, words in ((4_000_000, 1_000_000, 8_000), (1, 1_000_000, 8_000), (4_000_000, 900, 1)):
        for name, v in (("CELLS", cells), ("TEXT_CHARS", chars), ("PAIR_WORDS", words), ("ALIGNED_WORDS", words)):
            monkeypatch.setattr(contamination, name, v)
        calls.clear()
        found.append(sorted(tuple(r.values()) for b in contamination._match(seeds, 12, 0.5, 30)(iter([batch])) for r in b.to_pylist()))
        assert len(calls) < sum(calls) / 20 or words == 1
    assert found[0] == found[1] == found[2] and sum(calls) > 200
    want = {}
    for d, t in docs:
        w = contamination.words_of(t)
        code = np.array([seeds.vocab.get(x, 0) for x in w], np.int64)
        for i, item in enumerate(seeds.codes):
            if {tuple(w[k : k + 5]) for k in range(len(w) - 4)} & {tuple(items[i][1].split()[k : k + 5]) for k in range(len(item) - 4)}:
                run, score = contamination.longest_run(item, code), contamination.align(item, code)
                if run >= 12 or score >= 2 * min(0.5 * len(item), 30):
                    want[d, i] = (run, score)
    assert {(d, i): (run, score) for d, i, run, score, _ in found[0]} == want


def test_best_stretches_against_brute_force():
    rng = np.random.default_rng(4)
    size, most = rng.integers(0, 40, 50), rng.integers(0, 60, 50)
    known = rng.random(size.sum()) < 0.4
    want = []
    for part, m in zip(np.split(known, np.cumsum(size)[:-1]), most):
        want.append(max(int((3 * part[i:j] - 1).sum()) for i in range(len(part) + 1) for j in range(i, min(len(part), i + m) + 1)))
    assert contamination.best_stretches(known, size, most).tolist() == want


def test_windows_hold_what_seeds_can_reach():
    own = np.array([4, 2, 7, 9])  # n-grams of an item of eight words, n = 5
    first, last = np.full(10, -1), np.full(10, -1)
    first[2], last[2] = 20, 50
    assert contamination.window(own, first, last, 5) == (17, 50 + 5 + 6)
    first[9] = last[9] = 12
    assert contamination.window(own, first, last, 5) == (3, 61)


def test_alignment_against_the_textbook():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(1, 5, 12), rng.integers(0, 5, 30)
        h = np.zeros((13, 31))
        for i in range(1, 13):
            for j in range(1, 31):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert contamination.align(a, b) == h.max()


# ----------------------------------------------------------------------------------------------------- 9 mixing

TARGETS = "mix_id long, source string, target_share double, max_repeats int, total_share_of_corpus double"


def sources(n=600):
    rnd = random.Random(9)
    vocab = {s: [f"{s}parola{i}" for i in range(30)] for s in "abc"}
    rows = []
    for i in range(n):
        s = rnd.choice("aaabbc")
        rows.append((i, " ".join(rnd.choices(vocab[s], k=rnd.randrange(20, 60))), None if i % 20 == 0 else rnd.choice([s, s.upper(), s + " "]), s))
    return rows


def test_mix_reaches_its_targets(spark):
    rows = sources()
    df = clash(spark.createDataFrame([r[:3] for r in rows] + [(9000, None, "a"), (9001, "", "b"), (None, "x", "a")], "doc_id long, text string, source string").withColumnRenamed("text", "txt"))
    t = spark.createDataFrame([(1, "A", 0.2, 1, 0.5), (1, "b", 0.3, 2, 0.5), (1, "c", 0.5, 4, 0.5), (2, "c", 1.0, 2, 5.0), (3, "nowhere", 1.0, 1, 1.0), (3, "b", None, None, 1.0)], TARGETS)
    records, report = mixing.mix(df, t, text_col="txt", tokenizer=TOKENIZER)
    got = {(r.mix_id, r.source): r for r in report.collect()}
    for s, share in (("a", 0.2), ("b", 0.3), ("c", 0.5)):
        assert got[1, s].actual_share == pytest.approx(share, abs=0.01) and abs(got[1, s].actual_tokens - got[1, s].target_tokens) < 300 and got[1, s].most_copies <= {"a": 1, "b": 2, "c": 4}[s]
    assert got[2, "c"].most_copies == 2 and got[2, "c"].actual_tokens < got[2, "c"].target_tokens  # capped, falls short
    assert got[2, "c"].feasible_size == got[2, "c"].reach_tokens < got[2, "c"].target_tokens and got[1, "a"].feasible_size >= got[1, "a"].target_tokens / 0.2
    assert got[3, "nowhere"].actual_tokens == 0 and got[3, "b"].records == 0
    recs = records.collect()
    true = {r[0]: r[3] for r in rows}
    assert len({(r.mix_id, r.doc_id) for r in recs}) == len(recs) and np.mean([true[r.doc_id] == r.source for r in recs]) > 0.99
    assert mixing.mix(df.limit(0), t, text_col="txt", tokenizer=TOKENIZER)[0].count() == 0 and mixing.mix(df, t.limit(0), text_col="txt", tokenizer=TOKENIZER)[1].count() == 0


def test_no_target_is_dropped_at_the_bound(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    docs = spark.createDataFrame([(i, f"testo numero {i}", "abc"[i % 3]) for i in range(30)], "doc_id long, text string, source string")
    rows = [(m, s, 0.3, 2, 0.5) for m in (1, 2, 3) for s in "abc"]
    report = mixing.mix(docs, spark.createDataFrame(rows, TARGETS), tokenizer=TOKENIZER)[1].collect()
    assert {(r.mix_id, r.source) for r in report} == {r[:2] for r in rows} and len(report) == 9
    with pytest.raises(ValueError, match="more than 3 sources"):
        mixing.mix(docs, spark.createDataFrame([*rows, (1, "d", 0.1, 1, 0.5)], TARGETS), tokenizer=TOKENIZER)


def test_held_out_records_are_classified():
    rows = sources(900)
    model = mixing.fit_classifier([(r[3], r[1]) for r in rows[:600]], list("abc"))
    right = 0
    for _, text, _, s in rows[600:]:
        f = mixing.features(text)
        right += "abc"[int((model[1] + (model[0][:, f[:, 0]] * f[:, 1]).sum(1)).argmax())] == s
    assert right / 300 > 0.95


# ------------------------------------------------------------------------------------------------- 10 truncation


def test_truncation(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdeilmnorst", k=rnd.randrange(4, 9))) for _ in range(40)]
    sentence = lambda: "Il " + " ".join(rnd.choices(words, k=6)) + "."
    close = ["", "", "\nUfficio stampa", "\nRoma, 12 maggio 2020", "\nIl Direttore generale", "\n«Fine.»"]
    rows, cut = [], set()
    for i in range(600):
        t = "\n".join(" ".join(sentence() for _ in range(2)) for _ in range(5))
        if i % 10 == 0:
            t = t[: -rnd.randrange(3, 28)].rstrip(" .") + rnd.choice(["", "", "…", " [...]"])
            cut.add(i)
        else:
            t += rnd.choice(close)
        rows.append((i, t + rnd.choice(["", "\n", "  "]), rnd.choice(["S", "s "])))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, " ", None), (None, "Il ga", "s"), (1004, sentence() + ("\n" + sentence()) * 30_000, None), (1005, "…", "s")]
    df = clash(spark.createDataFrame(rows, "doc_id long, txt string, source string"))
    found = truncation.truncated(df, text_col="txt").collect()
    got = [r.doc_id for r in found]
    assert len(got) == len(set(got)) and set(got) == cut | {1005}
    assert [r.doc_id for r in found if r.verdict == "mark"] == [1005]  # all others are decided by their final trigram
    by = {r.source: r for r in truncation.truncation_by_source(df, text_col="txt").collect()}
    assert by["s"].cut == len(cut) + 1 and by[None].texts == 1 and by[None].cut == 0
    assert truncation.truncated(df.limit(0), text_col="txt").count() == 0


def test_abbreviations_are_judged_alike_in_any_corpus_size(spark):
    for n in (300, 3000):
        rows = [(i, f"Il testo numero {i}{chr(97 + i % 26)} cita quanto detto ai sensi dell' art. quattro del codice vigente.", "s") for i in range(n)] + [(9999, "Si decide ai sensi dell' art.", "s")]
        got = truncation.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert [(r.doc_id, r.verdict) for r in got] == [(9999, "sentence")], n


def test_copies_of_a_cut_text_do_not_make_its_end_usual(spark):
    rows = [(i, f"Il garante {chr(97 + i % 26)}{i} ha disposto la cancellazione dei dati.\nUfficio stampa", "s") for i in range(200)]
    rows += [(1000 + i, "Il garante numero uno ha disposto la cancellaz", "t") for i in range(60)]  # one cut text, taken over many times
    got = truncation.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got} == {1000 + i for i in range(60)}
