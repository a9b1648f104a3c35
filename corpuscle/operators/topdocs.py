"""The best documents of each query, without a row for each pair of a query and a chunk.

A task takes some queries and reads the chunks' vectors and the postings of its queries' words from the shared folder, batch by
batch, once if they fit into HELD, else once for each block of its queries. It holds two numbers for each chunk and query of a
block (CELLS) and some numbers for each chunk. Ranks and ties are those of hybrid_scores()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import italian as it
from corpuscle.session import materialise

#: Scores that a task holds at once: queries of a block times chunks, but one query at least.
CELLS = 4_000_000
#: Bytes of vectors, and of postings, that a task keeps; if there are more, it reads them again for each block.
HELD = 128 << 20
#: Queries of a task, at most; a task reads what it knows of each chunk once.
TASK_QUERIES = 256
RESULT = "query_id {q}, rank int, docweb_id {d}, score double, chunk_id string, activity_score double, activity_chunk string, violation_score double, violation_chunk string"


def top_documents(chunks: DataFrame, queries: DataFrame, postings: DataFrame | None, k: int, alpha: float) -> DataFrame:
    """The k best documents of each query, with their best chunk of all, of activity and of violation.

    chunks: (chunk_id, docweb_id, w, keep, role, embedding), a row each; only chunks to keep are results, all are ranked. queries:
    (query_id, embedding, terms, a), a row each. postings: (chunk_id, term, weight) of the queries' terms, None without keyword
    part. Equal scores go by chunk_id. Chunks whose vector is null, zero or of another length have no score, nor have queries."""
    table = materialise(chunks.where("embedding is not null").orderBy("chunk_id").withColumn("no", F.monotonically_increasing_id()), "scored")
    words = None
    if postings is not None:
        words = materialise(postings.join(table.select("chunk_id", "no"), "chunk_id").select("term", "no", F.col("weight").cast("double").alias("weight")).orderBy("term", "no"), "words")
    n = queries.count()
    tasks = max(1, min(n, max(2 * chunks.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_QUERIES))))
    schema = RESULT.format(q=dict(queries.dtypes)["query_id"], d=dict(chunks.dtypes)["docweb_id"])
    at, words_at, cells, held = table._table_path, words and words._table_path, CELLS, HELD
    return queries.repartition(tasks).mapInArrow(lambda batches: _task(batches, at, words_at, k, alpha, cells, held), schema)


def _batches(path: str, columns: list[str], where=None):
    """Record batches of a table below the shared folder, a few at a time."""
    import pyarrow.dataset as ds

    return ds.dataset(path, format="parquet").scanner(columns=columns, filter=where, batch_size=8192, batch_readahead=1, fragment_readahead=1, use_threads=False).to_batches()


def _vectors(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a length as rows of an array, and which rows of the column they are."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == size)
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size), rows


def _task(batches: Iterator, path: str, words: str | None, k: int, alpha: float, cells: int, held: int) -> Iterator:
    asked, types = [], None
    for b in batches:
        types = b.schema
        for i, v, t, a in zip(*(b.column(c).to_pylist() for c in ("query_id", "embedding", "terms", "a"))):
            if v is not None and any(v) and None not in v:
                asked.append((i, np.asarray(v, dtype=np.float64), t or [], a))
    for size in sorted({len(q[1]) for q in asked}):
        mine = [q for q in asked if len(q[1]) == size]
        index = _Chunks(path, size, held)
        if words and index.n:
            index.hold_postings(words, {t for q in mine for t in q[2]})
        block = max(1, cells // max(1, index.n))
        for s in range(0, len(mine) if index.n else 0, block):
            yield index.results(mine[s : s + block], path, words, k, alpha, types.field("query_id").type)


class _Chunks:
    """What a task knows of all chunks with a vector of a length; they are numbered by chunk_id."""

    def __init__(self, path: str, size: int, held: int):
        import pyarrow as pa

        parts, self.size, self.held, self.x, self.postings = [], size, held, None, None
        for b in _batches(path, ["no", "chunk_id", "docweb_id", "w", "keep", "role", "embedding"]):
            x, rows = _vectors(b.column("embedding"), size)
            x = x.astype(np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            ok = np.flatnonzero((norm > 0) & np.isfinite(norm))
            t = pa.Table.from_batches([b.select(["no", "chunk_id", "docweb_id", "w", "keep", "role"]).take(pa.array(rows[ok]))])
            parts.append(t.append_column("norm", pa.array(norm[ok])))
        t = pa.concat_tables(parts) if parts else None
        self.n = t.num_rows if parts else 0
        if not self.n:
            return
        t = t.take(pa.array(np.argsort(t["no"].to_numpy(), kind="stable"))).combine_chunks()
        self.no, self.w, norm, self.role = (t[c].to_numpy() for c in ("no", "w", "norm", "role"))
        self.scale = self.w * 1e9 / norm
        self.ids, docs = t["chunk_id"].combine_chunks(), t["docweb_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        self.docs, code = docs.dictionary, docs.indices.to_numpy()
        kept = np.flatnonzero(t["keep"].to_numpy())
        self.kept = kept[np.argsort(code[kept], kind="stable")]  # by document
        code = code[self.kept]
        self.starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else code
        self.ends, self.doc = np.r_[self.starts[1:], len(code)], code[self.starts]
        self.bits = self.n.bit_length()
        del t, parts
        pa.default_memory_pool().release_unused()

    def keys(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Of whole-numbered scores: numbers that sort by score descending, then by position. The position is in their last bits; if
        there is no room for it, they index the array that comes second."""
        bits, at = len(score).bit_length(), np.arange(len(score))
        if not len(score) or max(score.max(), -score.min()) < 1 << (62 - bits):
            key = np.negative(score)
            key <<= bits
            key |= at
            return key, None
        order = np.argsort(-score, kind="stable")
        key = np.empty(len(score), np.int64)
        key[order] = at
        return key, order

    def ranks(self, score: np.ndarray) -> np.ndarray:
        key, order = self.keys(score)
        if order is not None:
            return key
        key.sort()
        rank = np.empty(len(score), np.int64)
        rank[key & ((1 << len(score).bit_length()) - 1)] = np.arange(len(score))
        return rank

    def cosines(self, asked: list, path: str) -> np.ndarray:
        """Cosines times weights, in units of 1e-9: a row for each query."""
        q = np.stack([v / np.sqrt(v @ v) for _, v, _, _ in asked])
        out = np.empty((len(asked), self.n), np.int64)
        for at, x in self.vectors(path):
            s = q @ x.astype(np.float64).T
            s *= self.scale[at]
            out[:, at] = np.rint(s, out=s)
        return out

    def vectors(self, path: str) -> Iterator:
        """(positions, their vectors), some thousand at a time."""
        if self.x is not None:
            for s in range(0, self.n, 8192):
                yield slice(s, s + 8192), self.x[s : s + 8192]
            return
        keep = None
        for b in _batches(path, ["no", "embedding"]):
            x, rows = _vectors(b.column("embedding"), self.size)
            at, ok = self.positions(b.column("no").to_numpy()[rows])
            if keep is None and self.n * self.size * x.itemsize <= self.held:
                keep = np.empty((self.n, self.size), x.dtype)
            x = x[ok]
            if keep is not None:
                keep[at] = x
            yield at, x
        self.x = keep

    def positions(self, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chunks that have a score: their positions, and which they are."""
        at = np.minimum(np.searchsorted(self.no, no), self.n - 1)
        ok = np.flatnonzero(self.no[at] == no)
        return at[ok], ok

    def runs(self, words: str, terms: set[str]) -> Iterator:
        """(term, positions, weights) of some terms; a term may come in several parts."""
        import pyarrow as pa
        import pyarrow.dataset as ds

        if self.postings is not None:
            yield from ((t, *part) for t in terms for part in self.postings.get(t, ()))
            return
        for b in _batches(words, ["term", "no", "weight"], ds.field("term").isin(pa.array(sorted(terms), pa.string()))) if terms else ():
            term = b.column("term").dictionary_encode()
            code, weight = term.indices.to_numpy(), b.column("weight").to_numpy()
            cuts = np.flatnonzero(code[1:] != code[:-1]) + 1
            for s, e in zip([0, *cuts], [*cuts, len(code)]) if len(code) else ():
                at, ok = self.positions(b.column("no").to_numpy()[s:e])
                yield term.dictionary[int(code[s])].as_py(), at.astype(np.int32 if self.n < 1 << 31 else np.int64), weight[s:e][ok]

    def hold_postings(self, words: str, terms: set[str]) -> None:
        kept, size = {}, 0
        for t, at, weight in self.runs(words, terms):
            kept.setdefault(t, []).append((at, weight))
            size += at.nbytes + weight.nbytes
            if size > self.held:
                return
        self.postings = kept

    def keywords(self, asked: list, words: str) -> np.ndarray:
        """Sums of the weights of the queries' words, a row for each query."""
        by: dict[str, list[int]] = {}
        for i, (_, _, terms, _) in enumerate(asked):
            for t in terms:
                by.setdefault(t, []).append(i)
        out = np.zeros((len(asked), self.n))
        for t, at, weight in self.runs(words, set(by)):
            for i in by[t]:
                out[i, at] += weight
        return out

    def scores(self, cos: np.ndarray | None, word: np.ndarray | None, alpha: float, a: float) -> tuple[np.ndarray, float]:
        """A query's scores of all chunks, in whole numbers, and how many of them make one."""
        if alpha <= 0:
            return cos, 1e9
        lexical = np.rint(word * self.w * 1e9).astype(np.int64)
        if alpha >= 1:
            return lexical, 1e9
        fused = (1 - a) / (it.RRF_K + self.ranks(cos))
        own = np.flatnonzero(lexical > 0)
        fused[own] += a / (it.RRF_K + self.ranks(lexical[own]))
        return np.rint(fused * 1e12).astype(np.int64), 1e12

    def results(self, asked: list, path: str, words: str | None, k: int, alpha: float, query_type):
        import pyarrow as pa

        cos = self.cosines(asked, path) if alpha < 1 else None
        word = self.keywords(asked, words) if alpha > 0 and self.postings is None else None
        ids, rank, doc, score, best = [], [], [], [], [[], [], []]
        for i, (query, _, _, a) in enumerate(asked):
            if not len(self.kept):
                break
            own_word = word[i] if word is not None else self.keywords(asked[i : i + 1], words)[0] if alpha > 0 else None
            whole, unit = self.scores(cos[i] if cos is not None else None, own_word, alpha, a)
            key, order = self.keys(whole)
            of = lambda x: x & ((1 << self.bits) - 1) if order is None else order[x]  # noqa: B023, E731
            key = key[self.kept]
            first = np.minimum.reduceat(key, self.starts)
            top = np.argpartition(first, k - 1)[:k] if len(first) > k else np.arange(len(first))
            for r, j in enumerate(top[np.argsort(first[top])]):
                own, role = key[self.starts[j] : self.ends[j]], self.role[self.kept[self.starts[j] : self.ends[j]]]
                ids.append(query)
                rank.append(r + 1)
                doc.append(self.doc[j])
                for n, x in enumerate((own, own[role == 1], own[role == 2])):
                    best[n].append(int(of(x.min())) if len(x) else None)
                score.append([None if b[-1] is None else float(whole[b[-1]] / unit) for b in best])
        names = [self.ids.take(pa.array(b, pa.int64())) for b in best]
        value = [pa.array([s[n] for s in score], pa.float64()) for n in range(3)]
        columns = [pa.array(ids, query_type), pa.array(rank, pa.int32()), self.docs.take(pa.array(doc, pa.int64())), value[0], names[0], value[1], names[1], value[2], names[2]]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", "docweb_id", "score", "chunk_id", "activity_score", "activity_chunk", "violation_score", "violation_chunk"])
