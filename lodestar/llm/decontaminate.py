"""Benchmark decontamination by SimHash windows and exact weighted-shingle verification.

A document is contaminated by a benchmark item when one of its windows of the item's size has a weighted Jaccard
similarity of at least 75/100 to the item: five-word shingles, weighted by their counts. Words are runs of letters and
digits (A-Z lower-cased) or non-ASCII characters, so punctuation and layout don't hide a copy.

1. Windows that hold too few shingles of any item to reach the similarity are skipped; that bound is exact.
2. The other windows and the items have 64-bit SimHashes of their weighted shingles. These are cut into four blocks of
   16 bits. Two fingerprints within RADIUS bits differ by RADIUS // 4 or fewer bits in some block, so probing every
   block's distinct values that near finds all fingerprints within the radius.
3. Candidates are verified on their exact shingle weights. At a similarity of 0.75 the distance of two SimHashes is
   11 bits on average with a deviation of 3; a radius of 20 therefore finds all but about one in a thousand windows
   that just reach the similarity, and equal windows always.

Items are the stated query set: they are read in blocks of a fixed size, which are broadcast and held against all rows,
several in one pass over the documents. Of long texts, bit sums of SPAN windows are held at a time.
Edge cases: null or empty texts and items match nothing; an item or document of fewer than five words is one shingle,
its whole sequence, so it only matches an equal one; a document shorter than an item is one window; equal rows are
reported for each row, equal items by each id; null ids are carried; empty tables give no rows; other columns of the
inputs are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.hashing import NOT_ALNUM, document_shingles, mix

NUM, DEN = 75, 100
RADIUS, BLOCKS = 20, 4
#: Bounds of one block of benchmark items, and blocks that a pass over the documents holds.
BLOCK_ITEMS, BLOCK_BYTES, PASS_BLOCKS = 4096, 8 << 20, 8
#: Window starts whose bit sums are held at once.
SPAN = 1 << 15
SCHEMA = "doc_id long, item_id long, first_word long, similarity double"
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def _need(n: int) -> int:
    """Shingles in common that two bags of n need: x / (2n - x) >= NUM / DEN."""
    return -(-2 * n * NUM // (NUM + DEN))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 values -1 or 1 for each shingle."""
    return np.unpackbits(mix(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _simhash(sums: np.ndarray) -> np.ndarray:
    """Four 16-bit blocks of the fingerprint of each row of bit sums."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


class Items:
    """Fingerprints and shingle bags of a block of items, by window size."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids, self.bags, sizes, prints = [], [], [], []
        for row, found in document_shingles(pa.array([t for _, t in rows], pa.string()), NOT_ALNUM):
            if len(found):
                self.ids.append(rows[row][0])
                shingle, count = np.unique(found, return_counts=True)
                self.bags.append((shingle, count))
                sizes.append(len(found))
                prints.append(_simhash(_bits(found).sum(axis=0, keepdims=True))[0])
        self.shingles = np.unique(np.concatenate([b[0] for b in self.bags])) if self.bags else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        self.by_size: dict[int, list] = {}
        for size in sorted(set(sizes)):
            members = [i for i, s in enumerate(sizes) if s == size]
            mine = np.array([prints[i] for i in members])
            self.by_size[size] = [members, mine, [np.unique(mine[:, b], return_inverse=True) for b in range(BLOCKS)]]

    def hits(self, found: np.ndarray) -> np.ndarray:
        hit = self.seen[(found >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(hit)
        if len(at):
            place = np.minimum(np.searchsorted(self.shingles, found[at]), len(self.shingles) - 1)
            hit[at] = self.shingles[place] == found[at]
        return hit

    def near(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of all fingerprints within the radius."""
        members, mine, index = self.by_size[size]
        for lo in range(0, len(prints), 4096):
            some, pairs = prints[lo : lo + 4096], []
            for b, (values, of_item) in enumerate(index):
                order = np.argsort(of_item, kind="stable")
                cuts = np.searchsorted(of_item[order], np.arange(len(values) + 1))
                window, value = np.nonzero(_ONES[some[:, b][:, None] ^ values[None, :]] <= RADIUS // BLOCKS)
                each = cuts[value + 1] - cuts[value]
                item = order[np.repeat(cuts[value] - np.cumsum(each) + each, each) + np.arange(each.sum())]
                pairs.append(np.repeat(window, each) * len(members) + item)
            window, item = np.divmod(np.unique(np.concatenate(pairs)), len(members))
            close = _ONES[some[window] ^ mine[item]].sum(axis=1) <= RADIUS
            for w, i in zip((window[close] + lo).tolist(), item[close].tolist(), strict=True):
                yield w, members[i]

    def search(self, found: np.ndarray) -> list[tuple[int, int, float]]:
        """(item, first word of its best window, similarity) of a document's shingles."""
        hit = self.hits(found) if len(found) else np.zeros(0, bool)
        if not hit.any():
            return []
        before = np.concatenate([[0], np.cumsum(hit)])
        best: dict[int, tuple[float, int]] = {}
        for size in self.by_size:
            wide = min(size, len(found))
            if DEN * wide < NUM * size:
                continue
            every = np.flatnonzero(before[wide:] - before[:-wide] >= -(-NUM * (size + wide) // (NUM + DEN)))
            cuts = np.flatnonzero(np.diff(every // SPAN, prepend=-1)) if len(every) else []  # sums of bits over SPAN shingles at a time
            for starts in np.split(every, cuts[1:]) if len(every) else ():
                lo, hi = int(starts[0]), int(starts[-1]) + wide
                sums = np.zeros((hi - lo + 1, 64), np.int32)
                np.cumsum(_bits(found[lo:hi]), axis=0, out=sums[1:])
                prints = _simhash(sums[starts - lo + wide] - sums[starts - lo])
                for w, i in self.near(size, prints):
                    start = int(starts[w])
                    shingle, count = np.unique(found[start : start + wide], return_counts=True)
                    mine, weight = self.bags[i]
                    _, a, b = np.intersect1d(shingle, mine, assume_unique=True, return_indices=True)
                    shared = int(np.minimum(count[a], weight[b]).sum())
                    union = wide + size - shared
                    if DEN * shared >= NUM * union and (shared / union, -start) > best.get(i, (0.0, 1)):
                        best[i] = shared / union, -start
        return [(i, -start, similarity) for i, (similarity, start) in sorted(best.items())]


def _passes(benchmark: DataFrame) -> Iterator[list]:
    """Broadcasts of the items in blocks of a bounded size, PASS_BLOCKS at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    blocks, held = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(size / BLOCK_BYTES)), []
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held.append(spark.sparkContext.broadcast(Items([tuple(r) for r in mine.collect()])))  # BLOCK_BYTES, about
        if len(held) == PASS_BLOCKS or block == blocks - 1:
            yield held
            held = []


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): one row for each document row and item that it holds."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for blocks in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                ids = batch.column("doc_id").to_pylist()
                for row, found in document_shingles(batch.column("text"), NOT_ALNUM):
                    rows += [(ids[row], shared.value.ids[i], start, similarity) for shared in blocks for i, start, similarity in shared.value.search(found)]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.float64()], strict=True)], ["doc_id", "item_id", "first_word", "similarity"])

        found = texts.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    at = docs.columns.index("text")
    out = docs
    for blocks in _passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not any(shared.value.search(found) for shared in blocks) for _, found in document_shingles(batch.column(at), NOT_ALNUM)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
