"""Best-fit packing with swap-based local search.

Only the sizes of pieces matter to a packing, and there are at most `capacity` of them, so the packing is planned on
histograms of sizes: bins with the same content are one pattern with a multiplicity. The pieces are first packed as a
stream gives them: in PARTS parts by hash, each by best fit alone, which leaves each part with underfull bins of its own.
Then documents of the emptiest bin are moved, exchanged one for one or two for one with other underfull bins of any part,
always so that the sum of squared fills grows, until bins are empty or no exchange helps. Where that ends above the least
number that the sum of sizes allows, all pieces are dealt anew by best fit in descending order and searched again, and the
packing of fewer bins is taken. The plan's size depends on the capacity alone. Every piece then finds its bin by its rank among the pieces of its size: tasks number the pieces of
each size as they write them, and prefix sums over tasks make ranks of these numbers, so no size is sorted in one task.

A document longer than the capacity is cut into pieces of the capacity; only its first piece may be shorter. Edge
cases: a null or empty text is its end token alone; repeated rows are packed as often as they come; null ids are
carried; an empty table gives no rows; other columns of the input are ignored. Which piece of a size stands where depends
on how the table was read; the pieces and the sizes in every sequence do not.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import materialize
from lodestar.llm.encoding import Encoder

CAPACITY, END_ID = 2048, 0
#: Rows of a side up to which it is broadcast; above, the join shuffles.
BROADCAST_ROWS = 100_000
#: Parts of the stream that are packed by themselves before exchanges.
PARTS = 8


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces by size, number of bins) of best fit in descending order."""
    open_bins: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]  # by free space
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            free = next((f for f in range(size, capacity) if open_bins[f]), None)
            if free is None:
                each = capacity // size
                bins, rest = divmod(left, each)
                if bins:
                    open_bins[capacity - each * size].append(({size: each}, bins))
                if rest:
                    open_bins[capacity - rest * size].append(({size: rest}, 1))
                break
            pattern, bins = open_bins[free].pop()
            each = free // size
            full = min(bins, left // each)
            if full:
                open_bins[free - each * size].append((pattern | {size: pattern.get(size, 0) + each}, full))
                left -= full * each
            if full < bins:
                if left and left < each:
                    open_bins[free - left * size].append((pattern | {size: pattern.get(size, 0) + left}, 1))
                    left, full = 0, full + 1
                if full < bins:
                    open_bins[free].append((pattern, bins - full))
    return [x for group in open_bins for x in group]


def _transfer(giver: dict[int, int], taker: dict[int, int], free: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """The exchange that fills taker most: (gain, sizes given, sizes taken back)."""
    best = None

    def offer(given: tuple[int, ...], back: tuple[int, ...]) -> None:
        nonlocal best
        gain = sum(given) - sum(back)
        if 0 < gain <= free and (best is None or gain > best[0]):
            best = gain, given, back

    ones, others = sorted(giver), sorted(taker)
    for a in ones:
        offer((a,), ())
        for b in others:
            offer((a,), (b,))
    if best is None or best[0] < free:
        twos = {a + b: (a, b) for i, a in enumerate(ones) for b in ones[i:] if a != b or giver[a] > 1}
        backs = {a + b: (a, b) for i, a in enumerate(others) for b in others[i:] if a != b or taker[a] > 1}
        for total, pair in twos.items():
            for b in others:
                if 0 < total - b <= free:
                    offer(pair, (b,))
        for total, pair in backs.items():
            for a in ones:
                if 0 < a - total <= free:
                    offer((a,), pair)
    return best


def _sums(pattern: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of a pattern, and sums of two of its pieces."""
    ones = sorted(pattern)
    twos = {a + b for i, a in enumerate(ones) for b in ones[i:] if a != b or pattern[a] > 1}
    return np.array(ones, np.int64), np.array(sorted(twos), np.int64)


def _first(giver: tuple[np.ndarray, np.ndarray], takers: list[tuple[int, tuple[np.ndarray, np.ndarray]]]) -> int | None:
    """Place of the first of takers (free space, sums) that has an exchange with giver."""
    free = np.array([f for f, _ in takers])
    fits = giver[0][0] <= free
    for given, n in ((giver[0], 0), (giver[1], 0), (giver[0], 1)):
        back = [t[n] for _, t in takers]
        sizes = [len(x) for x in back]
        back = np.concatenate(back)
        above = np.searchsorted(given, back, side="right")  # the least that gives more than it takes back
        good = (above < len(given)) & (given[np.minimum(above, len(given) - 1)] - back <= np.repeat(free, sizes)) if len(given) else np.zeros(len(back), bool)
        fits[np.repeat(np.arange(len(takers)), sizes)[good]] = True
    return int(fits.argmax()) if fits.any() else None


def local_search(patterns: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Empty the least filled bins into the other underfull ones while the sum of squared fills can grow.

    An exchange is made in as many bins at once as both patterns have. A pattern without one is set aside with all its
    copies and later tried with patterns that came after, so each pair is tried once. It ends when no pair has an exchange,
    or when the free space is below one bin's, as then no packing has fewer bins.
    """
    counts: Counter[tuple] = Counter()
    fills: dict[tuple, int] = {}
    sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    live: list[tuple[int, tuple]] = []  # underfull patterns, fullest first
    active: list[tuple[int, tuple]] = []
    born: dict[tuple, int] = {}  # when the pattern came up last
    tried: dict[tuple, int] = {}  # it has no exchange with any that came up before
    aside: set[tuple] = set()
    clock = 0

    def add(pattern: dict[int, int], n: int) -> None:
        nonlocal clock
        if not (k := tuple(sorted(pattern.items()))):
            return
        had = counts[k]
        counts[k] += n
        if k not in fills:
            fills[k] = sum(s * c for s, c in k)
        if fills[k] < capacity and had < 2:  # one alone could not be tried with itself
            clock += 1
            born[k] = clock
            if k not in sums:
                sums[k] = _sums(dict(k))
            if not had:
                bisect.insort(live, (-fills[k], k))
            heapq.heappush(active, (fills[k], k))

    def take(k: tuple, n: int) -> None:
        counts[k] -= n
        if not counts[k]:
            del live[bisect.bisect_left(live, (-fills[k], k))]

    for pattern, n in patterns:
        add(pattern, n)
    spare = sum((capacity - fills[k]) * n for k, n in counts.items())
    while spare >= capacity:
        if not active:
            active = [(fills[k], k) for k in aside if counts[k] and tried[k] < clock]
            heapq.heapify(active)
            aside = set()
            if not active:
                break
        level, giver = heapq.heappop(active)
        if not counts[giver]:
            continue
        since = tried.get(giver, 0)
        takers = [k for f, k in live[: bisect.bisect_right(live, -level, key=lambda x: x[0])] if born[k] > since and counts[k] > (k == giver)]
        at_once = np.minimum(np.fromiter((counts[k] // (2 if k == giver else 1) for k in takers), np.int64, len(takers)), counts[giver])
        takers = [takers[i] for i in np.argsort(-at_once, kind="stable")]  # many bins at once first, among them the fullest
        taker, at, step = None, 0, 32
        while at < len(takers):
            some = takers[at : at + step]
            if (place := _first(sums[giver], [(capacity - fills[k], sums[k]) for k in some])) is not None:
                taker = some[place]
                break
            at, step = at + step, step * 4
        if taker is None:
            tried[giver] = clock
            aside.add(giver)
            continue
        _, given, back = _transfer(dict(giver), dict(taker), capacity - fills[taker])
        rest, changed = Counter(dict(giver)), Counter(dict(taker))
        rest.subtract(given)
        rest.update(back)
        changed.subtract(back)
        changed.update(given)
        bins = counts[giver] // 2 if taker == giver else min(counts[giver], counts[taker])
        take(giver, bins)
        take(taker, bins)
        if counts[giver]:
            heapq.heappush(active, (level, giver))
        if not +rest:
            spare -= capacity * bins
        add(+rest, bins)
        add(+changed, bins)
    return [(dict(k), n) for k, n in counts.items() if n]


def searched(parts: list[dict[int, int]], capacity: int) -> tuple[list[tuple[dict[int, int], int]], list[int]]:
    """(patterns, bins before the search, after it, and after the pieces were dealt anew) of histograms that are packed one
    by one first."""
    bins = [x for part in parts for x in best_fit(part, capacity)]
    steps = [sum(n for _, n in bins)]
    bins = local_search(bins, capacity)
    steps.append(sum(n for _, n in bins))
    if steps[1] > -(-sum(s * c * n for p, n in bins for s, c in p.items()) // capacity):
        again = local_search(best_fit(dict(sum(map(Counter, parts), Counter())), capacity), capacity)
        bins = min(bins, again, key=lambda x: sum(n for _, n in x))
    return bins, [*steps, sum(n for _, n in bins)]


def plan(parts: list[dict[int, int]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (size, first rank, end rank, pieces in a bin, first sequence, offset) that cover every piece of every size."""
    bins, _ = searched(parts, capacity)
    rows, used, sequence = [], Counter(), 0
    for pattern, n in bins:
        offset = 0
        for size in sorted(pattern, reverse=True):
            each = pattern[size]
            rows.append((size, used[size], used[size] + each * n, each, sequence, offset))
            used[size] += each * n
            offset += each * size
        sequence += n
    assert used == sum(map(Counter, parts), Counter()), "the plan must hold every piece"
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, task, number) of every piece of every document: number counts the
    pieces of its length in its task."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "task", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = Encoder(path, "bytes"), [0] * (capacity + 1), TaskContext.get().partitionId()
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            cols = [[] for _ in names]
            for doc, encoded in zip(ids, encoder.encode(t.as_py() or "" for t in batch.column("text")), strict=True):
                encoded += end
                total = len(encoded) // 4
                first = total % capacity or capacity
                for piece, stop in enumerate(range(first, total + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    crc, length = zlib.crc32(encoded[4 * start : 4 * stop]), stop - start
                    for c, x in zip(cols, (doc, piece, start, length, crc, crc % PARTS, task, seen[length]), strict=True):
                        c.append(x)
                    seen[length] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, task int, number long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    found = materialize(pieces(docs, path, capacity), "pieces")
    parts: list[dict[int, int]] = [{} for _ in range(PARTS)]
    for row in found.groupBy("part", "length").count().collect():  # capacity * PARTS rows at most
        parts[row["part"]][row["length"]] = row["count"]
    rows = plan(parts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast((rows, (rows[:, 0] << 48) + rows[:, 1]))
    # The pieces of a length in the tasks before: one row for each task and length.
    tasks = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    tasks = materialize(tasks.select("length", "task", before.alias("before")), "tasks")
    if tasks.count() <= BROADCAST_ROWS:
        tasks = F.broadcast(tasks)
    ranked = found.join(tasks, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            mine = rows[np.searchsorted(keys, (length << 48) + rank, side="right") - 1] if len(rank) else np.zeros((0, 6), np.int64)
            bins, place = np.divmod(rank - mine[:, 1], np.maximum(mine[:, 3], 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(mine[:, 4] + bins), pa.array(mine[:, 5] + place * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
