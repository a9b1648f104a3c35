"""Near-duplicate records: a size-aware heavy-light set similarity join over word shingles."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import materialise, pairs_within, small

SHINGLE_WORDS = 5
BITMAP_BITS = 1024
WORD = re.compile(r"\w+")
#: \bx{2,}\b or [omissis], written so that a search goes from one x or bracket to the next.
PLACEHOLDER = re.compile(r"x(?<!\wx)x+\b|\[omissis\]")
#: Words whose hashes a worker holds.
HELD_WORDS = 200_000


def band_plan(threshold: float, rows: int, miss: float = 0.002) -> int:
    """Number of subsets of `rows` minima so that a pair at the threshold shares none of them with probability <= miss."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


#: What filing a set costs, in keys shuffled: hashing so many elements for one minimum costs as much as one key.
HASHED_PER_KEY = 1000


def light_boundary(threshold: float, rows: int, bands: int) -> int:
    """Largest set size at which all 2-subsets of the prefix cost no more than the minima and the keys of a heavy set."""
    n = 2
    while math.comb(light_prefix(n + 1, threshold), 2) <= bands + rows * bands * (n + 1) / HASHED_PER_KEY:
        n += 1
    return n


def light_prefix(n: int, threshold: float) -> int:
    """Two sets of Jaccard >= threshold share at least two of their elements that come first in a common order, if so many
    are looked at: with overlap o = ceil(threshold * n), all but the last o - 2."""
    return min(n, n - math.ceil(threshold * n - 1e-9) + 2)


class _Hashes(dict):
    """Hashes of words with numbers made alike, held for later texts: at most HELD_WORDS, none of a very long word."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(alike(word))
        if len(word) <= 50:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def alike(word: str) -> str:
    """A word with its numbers made alike."""
    return re.sub(r"\d+", "0", word)


def distinct(a):
    """The distinct values of an array, in ascending order; np.unique takes several times as long for a few hundred."""
    import numpy as np

    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def _shingles(body: str | None):
    """Sorted distinct 64-bit hashes of the five-word sequences of a body (all words together if fewer)."""
    import numpy as np
    import xxhash

    words = WORD.findall(PLACEHOLDER.sub("x", (body or "").lower()))
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(" ".join(map(alike, words)))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    mul, m = np.uint64(0x9E3779B97F4A7C15), len(h) - SHINGLE_WORDS + 1
    out = h[:m].copy()
    for k in range(1, SHINGLE_WORDS):
        out = (out ^ (out >> np.uint64(29))) * mul + h[k : k + m]
    out ^= out >> np.uint64(32)
    return distinct(out * mul)


def minima(x, a, c, functions: int = 64, elements: int = 1024):
    """For each function its least value a * x + c over the elements x, in 32 bits; a part of both at a time, in one buffer."""
    import numpy as np

    out, buffer = np.full(len(a), 0xFFFFFFFF, np.uint32), np.empty(functions * min(elements, len(x)), np.uint32)
    for j in range(0, len(x), elements):
        y = x[j : j + elements]
        for i in range(0, len(a), functions):
            k = slice(i, min(i + functions, len(a)))
            values = buffer[: (k.stop - i) * len(y)].reshape(-1, len(y))
            np.multiply(a[k, None], y, out=values)
            np.add(values, c[k, None], out=values)
            np.minimum(out[k], values.min(1), out=out[k])
    return out


def _signatures(threshold: float, rows: int, bands: int, boundary: int):
    def sign(batches):
        import math as m

        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(20)
        a = (rng.integers(0, 2**32, rows * bands, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        c = rng.integers(0, 2**32, rows * bands, dtype=np.uint64).astype(np.uint32)
        mix = rng.integers(0, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        band_no = np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        pair = np.uint64(0x9FB21C651E98DF25)
        for b in batches:
            doc, ns, sigs, maps, keys = [], [], [], [], []
            for k, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = _shingles(body)
                n = len(s)
                if not n:
                    continue
                own = []
                if n <= m.floor(boundary / threshold):  # light, or large enough only to meet a light one
                    p = min(n, n - m.ceil(threshold * n - 1e-9) + 2)
                    i, j = np.triu_indices(p, 1)
                    own.append((s[i] * pair) ^ s[j])
                if n > boundary:
                    low = (s >> np.uint64(32)).astype(np.uint32)
                    least = minima(low ^ (low >> np.uint32(15)), a, c)
                    own.append(((least.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * mix).sum(1, dtype=np.uint64) ^ band_no)
                bits = np.bincount((s & np.uint64(BITMAP_BITS - 1)).astype(np.int64), minlength=BITMAP_BITS) & 1
                doc.append(k)
                ns.append(n)
                sigs.append(_sign(s))
                maps.append(np.packbits(bits.astype(np.uint8)).tobytes())
                keys.append(distinct(np.concatenate(own) if own else s[:0]).view(np.int64))
            offsets = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc, b.schema.field(0).type), pa.array(ns, pa.int32()), pa.array(sigs, pa.binary()), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "n", "sig", "bitmap", "keys"])

    return sign


def _possible(threshold: float):
    def keep(batches):
        """Drops pairs whose parity bitmaps differ in more bits than the threshold lets the sets differ in elements."""
        import numpy as np
        import pyarrow as pa

        ones = np.array([bin(i).count("1") for i in range(256)], np.uint16)
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("ma", "mb"))
            n = b.column("na").to_numpy().astype(np.int64) + b.column("nb").to_numpy()
            least_common = np.ceil(threshold / (1 + threshold) * n - 1e-9)
            ok = ones[x ^ y].sum(1) <= n - 2 * least_common
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return keep


def _sign(s) -> bytes:
    """Tells sets apart, and orders them."""
    import numpy as np

    return np.array([len(s), np.bitwise_xor.reduce(s), s.sum(dtype=np.uint64)], np.uint64).tobytes()


def _sets(batches):
    import pyarrow as pa

    for b in batches:
        sets = [(k, s) for k, s in zip(b.column(0).to_pylist(), map(_shingles, b.column(1).to_pylist())) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sets], b.schema.field(0).type), pa.array([_sign(s) for _, s in sets], pa.binary()), pa.array([s.tobytes() for _, s in sets], pa.binary())], names=["id", "sig", "s"])


def _jaccard(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        out = []
        for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            n = int((both[1:] == both[:-1]).sum())
            out.append(n / (len(both) - n))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], names=["a", "b", "jaccard"])


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, rows: int = 5, miss: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, jaccard) of class representatives, a < b, of Jaccard >= threshold over distinct five-word
    sequences, and members (id, rep): documents with equal sets share one representative, the smallest id.

    Every set is one of two kinds, by its size. The cost of a set is the number of keys under which it is filed; the boundary
    is the largest size at which a light set costs no more than a heavy one (see light_boundary).
    - Light sets are filed under all 2-subsets of those elements of theirs that come first in hash order, so many that
      two sets of the wanted similarity share at least two. That is exact.
    - Heavy sets are filed under subsets of `rows` random minima of the set, and the inverted lists of those are scanned. So
      many subsets are drawn that a pair exactly at the threshold is missed with probability at most `miss`, others more
      seldom. (Inverted lists of single elements, even of the rarest, grow with the square of the collection.) Lists that many
      sets share are scanned group by group, so no task holds a whole hot list.
    - Sets between the boundary and boundary / threshold are filed both ways, as they may match either kind.
    Candidates must pass two exact tests, without their sets at hand: sizes in proportion, and 1024-bit parity maps differing
    in no more bits than the sets may in elements. What is left is compared set by set. Sets are made from the whole text.

    Rows that repeat an id count once, by their greatest text; rows with a null id, and texts without any word, are in
    neither result. An empty table gives empty results."""
    bands = band_plan(threshold, rows, miss)
    boundary = light_boundary(threshold, rows, bands)
    one = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(one.dtypes)["id"]
    signed = materialise(one.mapInArrow(_signatures(threshold, rows, bands, boundary), f"id {id_type}, n int, sig binary, bitmap binary, keys array<long>"), "signed")
    # an id with several texts: the greatest set hash, so that every later step takes the same one
    picked = signed.groupBy("id").agg(F.max("sig").alias("sig"))
    members = materialise(picked.groupBy("sig").agg(F.min("id").alias("rep")).join(picked, "sig").select("id", "rep", "sig"), "members")
    reps = members.where("id = rep").select("id", "sig")
    classes = signed.join(reps, ["id", "sig"], "left_semi")
    filed = classes.select("id", "n", F.explode("keys").alias("key"))
    shared = materialise(filed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select("key"), "shared")
    filed = materialise(filed.join(small(shared), "key", "left_semi").distinct(), "filed")  # a small part of all
    fit = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-6
    pairs = materialise(pairs_within(filed, ["key"], extra=["n"]).where(fit).select("a", "b").distinct(), "candidates")
    maps = classes.groupBy("id").agg(F.first("n").alias("n"), F.first("bitmap").alias("m"))
    with_maps = pairs.join(maps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma")), "a").join(maps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb")), "b")
    likely = materialise(with_maps.mapInArrow(_possible(threshold), f"a {id_type}, b {id_type}"), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(reps, "id")
    sets = one.join(wanted.select("id"), "id", "left_semi").mapInArrow(_sets, f"id {id_type}, sig binary, s binary")
    sets = materialise(sets.join(wanted, ["id", "sig"], "left_semi").dropDuplicates(["id"]).select("id", "s"), "sets")
    full = likely.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    found = full.mapInArrow(_jaccard, f"a {id_type}, b {id_type}, jaccard double").where(F.col("jaccard") >= threshold - 1e-12)
    return found, members.select("id", "rep")


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, jaccard) of all documents, a < b: representatives' pairs for all their copies, and copies with each other."""
    m = members.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    n = members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.join(m, "a").join(n, "b").select("x", "y", "jaccard")
    copies = m.join(n, F.col("a") == F.col("b")).where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    return across.unionByName(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
