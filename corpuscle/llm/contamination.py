"""Evaluation texts leaking into training text: shared n-grams as seeds, exact bounds, then local alignment."""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Test items per pass over the corpus; a block's words and n-grams are what every executor holds.
BLOCK_ITEMS = 20_000
#: Texts that a task holds against the items at once: at most so many, and no more than this many cells of its tables need (a
#: text has one for each word and n-gram of the items), nor than have this many characters, and words for all pairs, if more than one.
TEXTS, CELLS = 64, 4_000_000
TEXT_CHARS, PAIR_WORDS = 1_000_000, 500_000
#: Pairs to align wait for others of their length: at most so many, with so many words, and so many words at a time.
POOL, POOL_WORDS, ALIGNED_WORDS = 256, 1_000_000, 8_000


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters or digits of the lower-cased text."""
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ..., so many for each k, one after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of so many values each."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    end = np.cumsum(size)
    return c[end] - c[end - size]


class Lists:
    """Arrays of different lengths in one."""

    def __init__(self, arrays: list[np.ndarray]):
        self.flat = np.concatenate([np.zeros(0, np.int64), *arrays])
        self.size = np.array([len(a) for a in arrays], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def of(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `flat` the values of the arrays k are, and how many each has."""
        return ragged(self.first[k], self.size[k]), self.size[k]


class Seeds:
    """The test items of one block: their words as numbers, their n-grams, and which items have an n-gram."""

    def __init__(self, items: list[tuple], n: int):
        self.n = n
        self.ids = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        self.codes = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(t)], np.int64) for _, t in items]
        self.lengths = np.array([len(c) for c in self.codes], np.int64)
        own = [self.grams(c)[1] for c in self.codes]
        self.table = np.unique(np.concatenate([np.zeros(0, np.int64), *own]))
        at = [np.searchsorted(self.table, g) for g in own]
        sets, times = zip(*(np.unique(a, return_counts=True) for a in at)) if at else ((), ())
        self.repeats = np.array([t.max(initial=0) for t in times], np.int64)
        gram, item = np.concatenate([np.zeros(0, np.int64), *sets]), np.repeat(np.arange(len(sets)), [len(a) for a in sets])
        self.owners = item[np.argsort(gram, kind="stable")]
        self.first = np.searchsorted(np.sort(gram), np.arange(len(self.table) + 1))
        self.ended = Lists([np.append(a, len(self.table)) for a in at])  # n-grams in order, then one that no text has
        bags = [np.unique(c, return_counts=True) for c in self.codes]
        self.words, self.times = Lists([w for w, _ in bags]), np.concatenate([np.zeros(0, np.int64), *(t for _, t in bags)])
        pairs = [self.pairs_of(c)[1] for c in self.codes]
        self.pair_table = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.pairs = Lists([np.searchsorted(self.pair_table, g) for g in pairs])
        #: What a text takes in the tables of Texts.
        self.cells = len(self.vocab) + len(self.table) + len(self.pair_table) + len(self.ids) + 3

    def least(self, items: np.ndarray, min_share: float, min_words: int) -> np.ndarray:
        """Half the score that makes a leak of an item: that of so many words."""
        return np.minimum(min_share * self.lengths[items], min_words) - 1e-6

    def pairs_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of two words in a row that items have, and a number for each such pair."""
        at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
        return at, codes[at] * (len(self.vocab) + 1) + codes[at + 1]

    def grams(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the runs of n words that items have, and a number for each run."""
        m = max(0, len(codes) - self.n + 1)
        known = codes > 0
        at = np.flatnonzero(np.logical_and.reduce([known[k : k + m] for k in range(self.n)]))
        out = np.zeros(len(at), np.int64)
        for k in range(self.n):
            out = (out * 1_000_003 + codes[at + k]) & 0x7FFFFFFFFFFFFFF
        return at, out

    @staticmethod
    def hits(table: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the numbers g are in a table, and their positions there."""
        if not len(table):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        p = np.minimum(np.searchsorted(table, g), len(table) - 1)
        k = np.flatnonzero(table[p] == g)
        return k, p[k]


class Texts:
    """Some texts at a time against the items: for each pair with a common n-gram bounds from above, and the stretch to align."""

    def __init__(self, seeds: Seeds, rows: int):
        self.seeds, self.rows = seeds, rows
        self.place = np.full((2, rows * (len(seeds.table) + 1)), -1, np.int64)  # where a text has an n-gram first and last
        self.two = np.zeros(rows * (len(seeds.pair_table) + 1), bool)
        self.slot = np.zeros(rows * (len(seeds.vocab) + 1), np.int64)

    def candidates(self, texts: list[str | None], min_run: int, min_share: float, min_words: int):
        """(number of the text, item, coded stretch of the text) of pairs that may be leaks."""
        s, get = self.seeds, self.seeds.vocab.get
        words = [words_of(t) for t in texts]
        for w in words:
            w.append("")  # in no item: nothing goes on into the next text
        size = np.array([len(w) for w in words])
        codes = np.fromiter(map(get, chain.from_iterable(words), repeat(0)), np.int64, size.sum())
        text, ends = np.repeat(np.arange(len(texts)), size), np.cumsum(size)
        at, g = s.grams(codes)
        k, p = s.hits(s.table, g)
        at, width = at[k], len(s.table) + 1
        key = text[at] * width + p
        first, last = self.place
        first[key[::-1]], last[key] = at[::-1], at
        try:
            yield from self._judged(codes, text, ends, np.flatnonzero(first[: len(texts) * width] >= 0), min_run, min_share, min_words)
        finally:
            first[key] = last[key] = -1

    def _judged(self, codes, text, ends, keys, min_run, min_share, min_words):
        s = self.seeds
        width, v, pw = len(s.table) + 1, len(s.vocab) + 1, len(s.pair_table) + 1
        if not len(keys):
            return
        # pairs of a text and an item that share n-grams, and how many at most
        gram = keys % width
        size = s.first[gram + 1] - s.first[gram]
        owned = np.repeat(keys // width * len(s.ids), size) + s.owners[ragged(s.first[gram], size)]
        held = np.bincount(owned)
        pair = np.flatnonzero(held)
        doc, item = pair // len(s.ids), pair % len(s.ids)
        least = s.least(item, min_share, min_words)
        by_run = held[pair] * s.repeats[item] >= min_run - s.n + 1
        by_run[by_run] = self._runs(doc[by_run], item[by_run]) >= min_run
        # words that both have, in whatever order: no alignment has more matches
        have = np.bincount(text * v + codes, minlength=len(ends) * v)
        k, size = s.words.of(item)
        common = sums(np.minimum(have[np.repeat(doc * v, size) + s.words.flat[k]], s.times[k]), size)
        keep = np.flatnonzero(by_run | (common >= least))
        doc, item, least, by_run, common = doc[keep], item[keep], least[keep], by_run[keep], common[keep]
        # places where the item has two words in a row that the text has too: no alignment has more of them.
        # m matches in r stretches score at most 2m - r + 1, and have m - r places where two matches are in a row
        at, g = s.pairs_of(codes)
        k, p = s.hits(s.pair_table, g)
        there = text[at[k]] * pw + p
        self.two[there] = True
        k, size = s.pairs.of(item)
        twos = sums(self.two[np.repeat(doc * pw, size) + s.pairs.flat[k]], size)
        self.two[there] = False
        keep = np.flatnonzero(by_run | (twos >= 2 * least - 1 - common))
        words, at = np.concatenate([[0], np.cumsum(np.diff(ends, prepend=0)[doc[keep]])]), 0
        while at < len(keep):
            to = max(at + 1, min(at + self.rows, int(np.searchsorted(words, words[at] + PAIR_WORDS, "right")) - 1))
            yield from self._stretches(codes, ends, *(a[keep[at:to]] for a in (doc, item, least, by_run, twos)))
            at = to

    def _runs(self, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
        """At least the length of the longest run of words that a text and an item share: the longest stretch of n-grams that are
        all there, in words."""
        if not len(item):
            return np.zeros(0, np.int64)
        k, size = self.seeds.ended.of(item)
        gaps = np.flatnonzero(self.place[0][np.repeat(doc * (len(self.seeds.table) + 1), size) + self.seeds.ended.flat[k]] < 0)
        best = np.maximum.reduceat(np.diff(gaps, prepend=-1) - 1, np.concatenate([[0], np.searchsorted(gaps, np.cumsum(size)[:-1] - 1) + 1]))
        return np.where(best > 0, best + self.seeds.n - 1, 0)

    def _stretches(self, codes, ends, doc, item, least, by_run, twos):
        s, v = self.seeds, len(self.seeds.vocab) + 1
        k, size = s.ended.of(item)
        place = np.repeat(doc * (len(s.table) + 1), size) + s.ended.flat[k]
        lo, hi = windows(self.place[0][place], self.place[1][place], size, s.n)
        lo, hi = np.maximum(lo, np.concatenate([[0], ends[:-1]])[doc]), np.minimum(hi, ends[doc] - 1)
        # the words that the item has too, each no more often than there
        k, size = s.words.of(item)
        own = np.repeat(np.arange(len(item)) * v, size) + s.words.flat[k]
        self.slot[own] = np.arange(1, len(own) + 1)
        span = hi - lo
        near = self.slot[np.repeat(np.arange(len(item)) * v, span) + codes[ragged(lo, span)]]
        self.slot[own] = 0
        m = sums(np.minimum(np.bincount(near, minlength=len(own) + 1)[1:], s.times[k]), size)
        # a score of 2 * least over m matches spans at most 3 * m - 2 * least words of the text
        good = (m >= least) & (twos >= 2 * least - 1 - m)
        some = np.flatnonzero(good & ~by_run)
        known = near[ragged((np.cumsum(span) - span)[some], span[some])] > 0
        good[some] = best_stretches(known, span[some], (3 * s.lengths[item[some]] - 2 * least[some]).astype(np.int64)) >= 2 * least[some]
        for j in np.flatnonzero(by_run | good):
            yield int(doc[j]), int(item[j]), codes[lo[j] : hi[j]].astype(np.int32)


def windows(first: np.ndarray, last: np.ndarray, size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of texts that an alignment over any seed of an item can reach. `first` and `last` are where a text has each of
    an item's n-grams (-1: nowhere), in the item's order and one more that it has nowhere; so many of them for each pair
    of text and item. Left of a seed at its word j an item has j words; they earn at most 2j, and as any part of the best
    alignment that begins it earns something, it spans at most 3j words; likewise on the right."""
    start = np.cumsum(size) - size
    j, there = ragged(np.zeros_like(size), size), first >= 0
    lo = np.minimum.reduceat(np.where(there, first - 3 * j, np.iinfo(np.int64).max), start)
    return lo, np.maximum.reduceat(np.where(there, last + n + 3 * (np.repeat(size, size) - 2 - j), 0), start)


def window(own: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> tuple[int, int]:
    """windows() of one item, whose n-grams are `own`, in a text alone."""
    lo, hi = windows(np.append(first[own], -1), np.append(last[own], -1), np.array([len(own) + 1]), n)
    return max(0, int(lo[0])), int(hi[0])


def best_stretches(known: np.ndarray, size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each stretch of a text, of so many words, the highest sum over at most `most` of its words in a row, 2 for one that the
    item has, -1 for another. An alignment over these words scores no more."""
    c = np.concatenate([[0], np.cumsum(3 * known.astype(np.int64) - 1)])
    # sums before and after each word of a stretch; those of an earlier stretch lie higher, so the least is of the same
    at = ragged(np.cumsum(size) - size, size + 1)
    which = np.repeat(np.arange(len(size)), size + 1)
    c = c[at] - which * (4 * len(known) + 4)
    most = np.minimum(most, size)
    low, out, reach = c, np.zeros(len(size), np.int64), 1  # low: least of the last `reach` sums
    starts = np.cumsum(size + 1) - size - 1
    while True:
        # most + 1 sums are two overlapping times `reach`
        now = np.flatnonzero((most + 1 >= reach) & (most + 1 < 2 * reach))
        if len(now):
            k = ragged(starts[now], size[now] + 1)
            back = np.repeat(most[now] + 1 - reach, size[now] + 1)
            least = np.minimum(low[k], low[np.maximum(k - back, 0)])
            out[now] = np.maximum.reduceat(c[k] - least, np.cumsum(size[now] + 1) - size[now] - 1)
        if 2 * reach > most.max(initial=0) + 1:
            return out
        low = np.minimum(low, np.concatenate([low[:reach], low[:-reach]])[: len(low)])
        reach *= 2


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Most consecutive words that two coded texts share (0 codes are words that no item has)."""
    return int(compare([a], [b])[1][0])


def align(item: np.ndarray, text: np.ndarray) -> float:
    """Smith-Waterman score of the best local alignment of two coded texts: 2 a match, -1 a mismatch or gap."""
    return float(compare([item], [text])[0][0])


def compare(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each item and its text the score of align() and longest_run(), for all pairs at once.

    Rows are words of the items. Scores are kept with their distance from the text's beginning added, which is what gaps along
    the text cost: these are taken in by a running maximum, and a row is a few vector steps in place."""
    k, n, m = len(items), max(map(len, items), default=0), max(map(len, texts), default=0)
    own, text = np.full((n, k, 1), -1, np.int32), np.full((k, m), -2, np.int32)
    for j, (a, b) in enumerate(zip(items, texts)):
        own[: len(a), j, 0], text[j, : len(b)] = a, b
    slope = np.arange(m + 1, dtype=np.int32)
    prev, cur, top = (np.tile(slope, (k, 1)) for _ in range(3))
    run, longer, longest = (np.zeros((k, m + 1), np.int32) for _ in range(3))
    for w in own:
        same = text == w
        np.subtract(prev, 1, out=cur)
        np.maximum(cur[:, 1:], prev[:, :-1] + same * np.int32(3), out=cur[:, 1:])
        np.maximum(cur, slope, out=cur)
        np.maximum.accumulate(cur, 1, out=cur)
        np.maximum(top, cur, out=top)
        np.multiply(run[:, :-1] + 1, same, out=longer[:, 1:])
        np.maximum(longest, longer, out=longest)
        prev, cur, run, longer = cur, prev, longer, run
    return (top - slope).max(1), longest.max(1)


def together(texts: list[str | None], rows: int):
    """(from, to) of texts in order that are judged at once."""
    start = chars = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and (k - start == rows or chars + n > TEXT_CHARS):
            yield start, k
            start, chars = k, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def alike(pairs):
    """The pairs, whose last part is the text, in groups of like lengths."""
    pool, held = [], 0

    def groups():
        some: list[tuple] = []
        for p in sorted(pool, key=lambda p: -len(p[-1])):
            if some and (len(some) + 1) * len(some[0][-1]) > ALIGNED_WORDS:
                yield some
                some = []
            some.append(p)
        if some:
            yield some

    for p in pairs:
        pool.append(p)
        held += len(p[-1])
        if len(pool) == POOL or held > POOL_WORDS:
            yield from groups()
            pool, held = [], 0
    yield from groups()


def _match(seeds: Seeds, min_run: int, min_share: float, min_words: int):
    def match(batches):
        import pyarrow as pa

        rows = max(1, min(TEXTS, CELLS // seeds.cells))
        block = Texts(seeds, rows)
        for b in batches:
            docs, texts, found = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            pairs = ((docs[at + k], *rest) for at, to in together(texts, rows) for k, *rest in block.candidates(texts[at:to], min_run, min_share, min_words))
            for some in alike(pairs):
                which = np.array([i for _, i, _ in some])
                score, run = compare([seeds.codes[i] for i in which], [t for *_, t in some])
                leak = (run >= min_run) | (score >= 2 * seeds.least(which, min_share, min_words))
                share = score / (2.0 * seeds.lengths[which])
                found += [(some[k][0], seeds.ids[which[k]], int(run[k]), float(score[k]), float(share[k])) for k in np.flatnonzero(leak)]
            types = (b.schema.field(0).type, pa.int64(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], types[k]) for k in range(5)], names=["doc", "item", "run", "score", "share"])

    return match


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "item_text", min_run: int = 12, n: int = 5, min_share: float = 0.5, min_words: int = 30, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc, item, run, score, share): every document with a passage of a test item.

    `run` is the longest sequence of consecutive words they share, `score` that of the best local alignment (2 a match, -1
    a mismatch or gap), `share` the score divided by that of the whole item. A pair is given if run >= min_run, or if the aligned
    stretch is worth min_share of the item or min_words words, whichever is less: an edited or paraphrased copy of all
    of an item or of a part.

    Items come in blocks of a fixed number, and each block is held against all documents: the corpus is read once a block
    and never shuffled. Every n-gram of an item is a seed, however many documents have it: all pairs that share one are
    judged, so no shared run of min_run words is missed, and of edited copies only those that keep no n words in a row. A
    pair is left unaligned only if its longest stretch of shared n-grams rules out min_run, and the words shared, in
    twos or close together, rule out the score; as these are bounds from above, nothing is lost by them. Alignments are
    made around the seeds, as far as any alignment over a seed can reach. Texts are judged, and pairs aligned, many at a time.

    Null ids give no rows; null and empty texts hold nothing; items without n words in a row are never found; items that
    repeat an id count each, and documents that repeat a row give one row. Empty in, empty out."""
    spark, doc_type = docs.sparkSession, dict(docs.dtypes)[id_col]
    corpus = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    schema = f"doc {doc_type}, item long, run int, score double, share double"
    found = spark.createDataFrame([], schema)
    listed = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    blocks = max(1, -(-listed.count() // block_items))
    for k in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else listed
        seeds = Seeds(sorted(((r.i, r.t or "") for r in part.collect())), n)
        if not len(seeds.table):
            continue
        found = found.unionByName(corpus.mapInArrow(_match(seeds, min_run, min_share, min_words), schema))
    return found.groupBy("doc", "item").agg(F.max("run").alias("run"), F.max("score").alias("score"), F.max("share").alias("share"))
