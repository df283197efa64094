"""Benchmark decontamination by SimHash windows and verified shingle similarity.

Method: a benchmark item and every item-sized window of a document get a
128-bit SimHash of their weighted five-word shingles.  A multi-index over
``BLOCKS`` blocks of the fingerprint finds every item within ``RADIUS`` bits
of a window: by the pigeonhole principle one block differs in at most
``RADIUS // BLOCKS`` bits, and a block's table lists the items within that
distance of each block value, so no fingerprint within the radius is missed.
Candidates are confirmed by exact weighted-shingle similarity (weighted
Jaccard, 100 * sum of minima >= 75 * sum of maxima).

At similarity 0.75 two fingerprints differ in 22 +- 4.3 of 128 bits (random
ones in 64 +- 5.7), so ``RADIUS`` = 40 keeps true pairs with a margin of four
standard deviations.  A window that shares no shingle with any item has similarity
zero, so only windows over shared shingles are fingerprinted.

Weights: a shingle weighs 1 + ln(items / items that contain it), so stock
phrases of the benchmark count less; repeats add up.  Counts are taken over the whole benchmark, whatever its blocks.

Distribution: the benchmark is the query set.  Its shingles, their counts and
the fingerprints are made in Spark; the weights of shingles that several items
have go to all tasks once (all others weigh the same).  The finished items are
cut into blocks of ``ITEMS`` items and about ``ITEM_BYTES`` of shingles, and
each block's index goes to all tasks, which read the documents in one narrow
map; a larger benchmark means more blocks, not a larger index.

Normal form: texts and items are lower-cased (all letters) and ASCII
punctuation separates words like white space does, so a passage in capitals
or with noise signs between its words is still the passage.  Word positions
in results count words of this form.

Defined cases: null or empty texts match nothing; items with fewer than five
words are one shingle, their whole word sequence, and match only documents
that consist of it; rows that share an item_id with different texts are
matched each; rows with a null doc_id are matched like others and reported
with a null id; empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import text as T
from churnlens.session import ship_package

K = 5
PERCENT = 75
BITS, BLOCKS, RADIUS = 128, 16, 40
BLOCK_BITS = BITS // BLOCKS
ITEMS = 4096
ITEM_BYTES = 16 << 20


_SEPARATORS = np.ones(256, bool)
_SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _words(data: np.ndarray, offsets: np.ndarray) -> T.Words:
    return T.words_of(data, offsets, _SEPARATORS)


def _bits(h: np.ndarray) -> np.ndarray:
    """+1 / -1 in 128 columns for every shingle hash."""
    two = np.stack((h, T.mix64(h ^ np.uint64(0xC2B2AE3D27D4EB4F))), axis=1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """16 bytes of each fingerprint."""
    return np.packbits(sums > 0, axis=1)


_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Weights:
    """Shingle weights over the whole benchmark: those of several items are listed, all others weigh the same."""

    def __init__(self, n_items: int, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.shingles = shingles[order]
        self.weight = 1 + np.log(n_items / counts[order])
        self.default = 1 + float(np.log(max(1, n_items)))  # of a shingle that one item has or none

    def of(self, sh: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(sh), self.default)
        at = np.minimum(np.searchsorted(self.shingles, sh), len(self.shingles) - 1)
        return np.where(self.shingles[at] == sh, self.weight[at], self.default)


class Index:
    """One block of benchmark items: shingles, fingerprints and the multi-index."""

    def __init__(self, rows: list, weights: Weights):
        self.weights = weights
        self.ids, self.items, self.words, prints = [], [], [], []
        self.short: dict[int, list[int]] = defaultdict(list)
        for r in rows:
            sh = np.frombuffer(r["shingles"], np.uint64)
            if r["words"] < K:
                self.short[int(sh[0])].append(r["item_id"])
                continue
            self.ids.append(r["item_id"])
            self.items.append(sh)
            self.words.append(r["words"])
            prints.append(np.frombuffer(r["print"], np.uint8))
        self.known = np.unique(np.concatenate(self.items)) if self.items else np.zeros(0, np.uint64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.sets = [self._weighted(sh) for sh in self.items]
        self.prints = np.array(prints, np.uint8).reshape(len(self.items), BITS // 8)
        self.sizes = np.array(sorted(set(self.words)), np.int64)
        self.tables = self._tables()

    def _weighted(self, sh: np.ndarray) -> dict[int, float]:
        out: dict[int, float] = defaultdict(float)
        for h, w in zip(sh.tolist(), self.weights.of(sh).tolist()):
            out[h] += w
        return dict(out)

    def _tables(self) -> np.ndarray:
        """tables[block, value]: row of item flags; items whose block is within RADIUS // BLOCKS bits of value."""
        reach = RADIUS // BLOCKS
        masks = [sum(1 << i for i in c) for r in range(reach + 1) for c in combinations(range(BLOCK_BITS), r)]
        out = np.zeros((BLOCKS, 1 << BLOCK_BITS, (len(self.items) + 7) // 8), np.uint8)
        flags = np.zeros((BLOCKS, 1 << BLOCK_BITS, len(self.items)), bool)
        for i, p in enumerate(self.prints):
            for b in range(BLOCKS):
                flags[b, [int(p[b]) ^ m for m in masks], i] = True
        out[...] = np.packbits(flags, axis=2)
        return out

    def hits(self, sh: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        maybe = np.flatnonzero(self.bitmap[(sh >> np.uint64(44)).astype(np.int64)])
        if not len(maybe) or not len(self.known):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.known, sh[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == sh[maybe]]

    def match(self, sh: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, last word + 1, similarity) of one document, the best window of each item."""
        best: dict[int, tuple[float, int, int]] = {}
        longest = int(self.sizes[-1]) - K + 1
        # runs of windows that can touch a shared shingle
        start, stop = np.maximum(hits - longest + 1, 0), np.minimum(hits + longest, len(sh))
        new = np.ones(len(hits), bool)
        new[1:] = start[1:] > stop[:-1]
        first = np.flatnonzero(new)
        for a, z in zip(start[first], stop[np.append(first[1:], len(hits)) - 1]):
            # long runs go in overlapping pieces, so memory follows the longest item only
            for p in range(a, z, 4096):
                self._run(sh, p, min(z, p + 4096 + longest), best)
        return [(i, s, e, sim) for i, (sim, s, e) in sorted(best.items())]

    def _run(self, sh: np.ndarray, a: int, z: int, best: dict) -> None:
        part = sh[a:z]
        w = self.weights.of(part)
        cum = np.zeros((len(part) + 1, BITS), np.float32)
        np.cumsum(_bits(part) * w[:, None].astype(np.float32), axis=0, out=cum[1:])
        shared = np.concatenate(([0], np.cumsum(np.isin(part, self.known))))
        for words in self.sizes:
            n = int(words) - K + 1
            if len(part) < n:
                # a document shorter than the item is compared whole
                at, ends = np.array([0]), np.array([len(part)])
            else:
                at = np.arange(len(part) - n + 1)
                ends = at + n
            # the weighted similarity needs at least this share of common shingles' weight
            some = shared[ends] > shared[at]
            at, ends = at[some], ends[some]
            if not len(at):
                continue
            prints = _packed(cum[ends] - cum[at])
            flags = self.tables[0][prints[:, 0]]
            for b in range(1, BLOCKS):
                flags = flags | self.tables[b][prints[:, b]]
            mask = np.unpackbits(flags, axis=1)[:, : len(self.items)].astype(bool)
            mask &= np.array(self.words)[None, :] == words
            row, item = np.nonzero(mask)
            if not len(row):
                continue
            far = _POPCOUNT[prints[row] ^ self.prints[item]].sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(far <= RADIUS)
            for r in near[np.argsort(far[near], kind="stable")]:
                self._confirm(part, int(at[row[r]]), int(ends[row[r]]), int(item[r]), a, best)

    def _confirm(self, part, s: int, e: int, item: int, a: int, best: dict) -> None:
        known = best.get(item)
        if known and known[0] == 1.0:
            return
        have, want = self._weighted(part[s:e]), self.sets[item]
        low = sum(min(v, have[h]) for h, v in want.items() if h in have)
        high = sum(want.values()) + sum(have.values()) - low
        if 100 * low >= PERCENT * high - 1e-9:
            sim = min(1.0, low / high)
            if not known or (sim, -(a + s)) > (known[0], -known[1]):
                best[item] = (sim, a + s, a + e + K - 1)


def _item_shingles(text: pa.Scalar) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(text.as_buffer(), np.uint8)
    x = _words(raw, np.array([0, len(raw)]))
    return len(x.start), T.shingles_of(x.hashes(), x.first, K)[0]


def _weights(items: DataFrame) -> Weights:
    """Counts over all items; only shingles of several items come to the driver."""

    def run(batches):
        for b in batches:
            own = [np.unique(_item_shingles(t)[1]) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    counts = items.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toArrow()
    shingles = counts.column("h").to_numpy().astype(np.int64).view(np.uint64)
    return Weights(items.count(), shingles, counts.column("n").to_numpy())


ITEM = "item_id long, words int, shingles binary, print binary"


def _index_blocks(items: DataFrame, weights) -> Iterator[Index]:
    """Indexes of blocks of items, whose finished rows are read one after another; each is bounded by the parameters."""

    def run(batches):
        for b in batches:
            rows = []
            for item, t in zip(b.column("item_id").to_pylist(), b.column("text")):
                words, sh = _item_shingles(t)
                if words:
                    sums = (_bits(sh) * weights.value.of(sh)[:, None]).sum(axis=0, keepdims=True)
                    rows.append((item, words, sh.tobytes(), _packed(sums)[0].tobytes()))
            cols = list(zip(*rows)) if rows else [[]] * 4
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["item_id", "words", "shingles", "print"])

    block: list = []
    size = 0
    for r in items.mapInArrow(run, ITEM).orderBy("item_id", "shingles").toLocalIterator():
        block.append(r)
        size += len(r["shingles"])
        if len(block) >= ITEMS or size >= ITEM_BYTES:
            yield Index(block, weights.value)
            block, size = [], 0
    if block:
        yield Index(block, weights.value)


LEAK = "doc_id long, item_id long, start_word int, end_word int, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for every (document, item) found, with the best window and its similarity."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"))
        .where("text is not null")
        .distinct()
    )
    weights = spark.sparkContext.broadcast(_weights(items))
    out = None
    for index in _index_blocks(items, weights):
        index.weights = None  # it has a broadcast of its own
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            index.weights = weights.value
            for b in batches:
                ids = b.column("doc_id")
                rows = []
                for i, j, data, offsets in T.text_chunks(b.column("text")):
                    x = _words(data, offsets)
                    sh, off = T.shingles_of(x.hashes(), x.first, K)
                    counts = np.diff(x.first)
                    if index.short:
                        for d in np.flatnonzero((counts > 0) & (counts < K)):
                            for item in index.short.get(int(sh[off[d]]), ()):
                                rows.append((ids[i + int(d)].as_py(), item, 0, int(counts[d]), 1.0))
                    hits = index.hits(sh)
                    hit_doc = np.searchsorted(off, hits, "right") - 1
                    for d in np.unique(hit_doc):
                        if counts[d] >= K:
                            own = sh[off[d] : off[d + 1]]
                            for item, s, e, sim in index.match(own, hits[hit_doc == d] - off[d]):
                                rows.append((ids[i + int(d)].as_py(), index.ids[item], s, e, sim))
                cols = list(zip(*rows)) if rows else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "start_word", "end_word", "similarity"]
                )

        part = texts.mapInArrow(run, LEAK)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], LEAK)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item (rows with a null doc_id stay)."""
    found = contaminated(docs, benchmark).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
