"""Exact n-gram Jaccard self-join with set-relation skipping.

Sets of word shingles are linked when their Jaccard similarity reaches num/den (0.75). Two relations between sets are
used to skip work without losing a link:

* Index-level skipping. Pairs come from inverted lists of prefix tokens in one global order (rare tokens first). A list
  whose sets have one component is skipped whole; a long list is cut into blocks by set size, and a block is skipped when
  its sizes or its smallest position cannot reach the required overlap.
* Answer-level skipping. Equal sets are one node. Sets that share a min-hash key get a star of verified links to one
  leader, and so do the sets of a long inverted list to the set with the fewest rare tokens, which the others most
  likely resemble. What remains for the lists are pairs of different components. The answers of a set (its links) are then
  derived from those of its component's head, a set that the others are near to: with the difference D(Y) of each member
  to the head, computed once, two members are |D(Y)| + |D(Z)| - 2 |D(Y) & D(Z)| apart, and linked when that is at most a
  seventh of their sizes together. |D(Y)| + |D(Z)| alone settles most pairs: those are counted from a histogram. The rest
  is counted on differences, block by block; blocks whose members are all linked, or can't be, are skipped. Links are
  counted, not listed, so a group of copies never becomes pairs of rows.

All pairs between components are verified on their whole sets, 64 bits a shingle. Nodes are 64-bit digests of whole sets:
two of n different sets meet with a chance of n * n / 2 ** 65. Edge cases: a null or empty text, or one without words, is the
empty set, linked with nothing, its own component; fewer than five words make one shingle; repeated rows come back as
often as they came in and are linked; a null doc_id is kept and never chosen as component id unless the whole component
has none; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import materialize
from lodestar.llm.components import connected_components
from lodestar.llm.hashing import SPACE, document_shingles, mix

NUM, DEN, WORDS = 75, 100, 5
#: Min-hash keys of a set; each sends it to one leader.
KEYS = 4
#: Tokens that the global order puts last, at most; fixes the size of the broadcast (4 bytes each).
FREQUENT_TOKENS, FREQUENT_FROM = 1 << 20, 8
#: Rows of the candidate side up to which it is broadcast; above, the join shuffles.
BROADCAST_ROWS = 1_000_000
BLOCK = 64
#: Lists from this length on get a star before their pairs.
STAR_FROM = 16
#: Rows of one key that a join takes into one task; more are dealt by salts.
KEY_ROWS = 500
#: Shingles that a bucket of inverted lists holds on average, and those of the differences in a block of members.
BUCKET_TOKENS, BLOCK_TOKENS = 2 << 20, 1 << 17


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, int | None]]:
    """(row, sorted distinct shingles, 64-bit node of the set or None)."""
    for row, found in document_shingles_k(batch.column("text"), k):
        distinct = np.unique(found)
        node = None
        if len(distinct):
            total = mix(distinct ^ np.uint64(0x6A09E667F3BCC909)).sum(dtype=np.uint64)
            node = int(_signed(mix(np.array([total ^ np.uint64(len(distinct))])))[0])
        yield row, distinct, node


def document_shingles_k(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    if k == WORDS:
        yield from document_shingles(column, SPACE)
        return
    from lodestar.llm.hashing import shingles, slices, words

    for lo, hi, data, offsets in slices(column):
        found, firsts = shingles(*words(data, offsets, SPACE), k)
        for i in range(hi - lo):
            yield lo + i, found[firsts[i] : firsts[i + 1]]


def shingle_sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, node, n_shingles, keys, counts): one row per document; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, counts = [], [], [], []
            for _, found, node in _sets(batch, k):
                nodes.append(node)
                sizes.append(len(found))
                mine = []
                for j in range(KEYS if len(found) else 0):
                    part = mix(found ^ np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min()
                    mine.append(int(_signed(mix(np.array([part + np.uint64(j)])))[0]))
                keys.append(mine)
                counts.append(_counts(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.binary())], ["doc_id", "node", "n_shingles", "keys", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, node long, n_shingles long, keys array<long>, counts binary")


def _counts(found: np.ndarray) -> bytes | None:
    """How many shingles fall into each of about n / 2 classes; None where a class has more than a byte can say."""
    classes = 64
    while 2 * classes < len(found):
        classes *= 2
    counts = np.bincount((found & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return None if counts.max(initial=0) > 255 else counts.astype(np.uint8).tobytes()


def most_shared(a: bytes | None, b: bytes | None) -> int | None:
    """A bound of the size of the intersection of two sets by their counts."""
    if a is None or b is None:
        return None
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b))
    classes = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, classes).sum(axis=0), y.reshape(-1, classes).sum(axis=0)).sum())


def _prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _packed(tokens: np.ndarray) -> bytes:
    """Sorted tokens as differences, by planes of bytes, which compress."""
    return np.diff(tokens, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _tokens(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _frequent(docs: DataFrame, k: int, buckets: int) -> np.ndarray:
    """The 32-bit tokens found in the most documents, FREQUENT_TOKENS at most, sorted. Any choice of them gives the same
    result; it only sets the global order of tokens."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(sets: dict) -> pa.RecordBatch:
            every = np.sort(np.concatenate(list(sets.values())))
            cuts = np.searchsorted((every.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), np.arange(buckets + 1))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int64()), pa.array([_packed(every[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["bucket", "tokens"])

        sets, size = {}, 0
        for batch in batches:
            for _, found, node in _sets(batch, k):
                if node is not None and node not in sets:
                    sets[node] = (found >> np.uint64(32)).astype(np.uint32)
                    size += len(found)
                    if size > 4 << 20:
                        yield flush(sets)
                        sets, size = {}, 0
        if sets:
            yield flush(sets)

    def count(found: pa.Table) -> pa.Table:
        every = [_tokens(x) for x in found.column("tokens").to_pylist() if x]
        token, df = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint32), return_counts=True)
        often = df >= FREQUENT_FROM
        return pa.table({"token": pa.array(token[often].astype(np.int64)), "df": pa.array(df[often].astype(np.int64))})

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(spread, "bucket long, tokens binary").groupBy("bucket").applyInArrow(count, "token long, df long")
    counts = materialize(counts, "frequent")
    level = F.floor(F.log2("df"))
    total, least = 0, None
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 64 rows at most
        if total + row["count"] > FREQUENT_TOKENS:
            break
        total, least = total + row["count"], row["level"]
    if least is None:
        return np.zeros(0, np.uint32)
    rows = counts.filter(level >= least).select("token").toPandas()
    return np.sort(rows["token"].to_numpy().astype(np.uint32))


def _prefixes(docs: DataFrame, frequent, k: int) -> DataFrame:
    """(node, n, n_rare, rare, late): of each distinct set the first tokens in the global order, which puts the rare ones
    first and each kind in order of the token, and how many rare ones it has in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for batch in batches:
            nodes, sizes, rares, rare, late = [], [], [], [], []
            for _, found, node in _sets(batch, k):
                if node is None:
                    continue
                mine = (found >> np.uint64(32)).astype(np.uint32)
                often = np.zeros(len(mine), bool)
                if len(last):
                    often = last[np.minimum(np.searchsorted(last, mine), len(last) - 1)] == mine
                length = _prefix_length(len(found))
                first = mine[~often][:length]
                nodes.append(node)
                sizes.append(len(found))
                rares.append(len(mine) - int(often.sum()))
                rare.append(_packed(first))
                late.append(_packed(mine[often][: length - len(first)]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rares, pa.int64()), pa.array(rare, pa.binary()), pa.array(late, pa.binary())], ["node", "n", "n_rare", "rare", "late"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, n long, n_rare long, rare binary, late binary").dropDuplicates(["node"])


def list_pairs(token: np.ndarray, node: np.ndarray, group: np.ndarray, size: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Candidate pairs (smaller node, larger node) of inverted lists: arrays of entries in any order.

    position is the entry's place (from 0) in its set's token order. Sets of one group are not paired.
    """
    order = np.lexsort((size, token))
    token, node, group, size, position = token[order], node[order], group[order], size[order], position[order]
    firsts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(firsts, len(token)))
    if not len(firsts):
        return np.zeros((0, 2), np.int64)
    mixed = np.minimum.reduceat(group, firsts) != np.maximum.reduceat(group, firsts)
    out = []

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        need = -(-NUM * (size[a] + size[b]) // (NUM + DEN))
        reach = np.minimum(size[a] - position[a], size[b] - position[b])
        return (group[a] != group[b]) & (DEN * size[a] >= NUM * size[b]) & (reach >= need)

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        good = fits(a, b)
        if good.any():
            x, y = node[a[good]], node[b[good]]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))

    for gap in range(1, 16):  # short lists, all at once
        at = np.concatenate([firsts[mixed & (lengths <= 16) & (lengths > gap + i)] + i for i in range(16 - gap)] or [np.zeros(0, np.int64)])
        if len(at):
            keep(at, at + gap)
    for first, length in zip(firsts[mixed & (lengths > 16)], lengths[mixed & (lengths > 16)], strict=True):
        blocks = np.arange(first, first + length, BLOCK)
        least = size[blocks]
        reach = np.maximum.reduceat(size[first : first + length] - position[first : first + length], blocks - first)
        lone = np.minimum.reduceat(group[first : first + length], blocks - first)
        lone = np.where(lone == np.maximum.reduceat(group[first : first + length], blocks - first), lone, -1)
        for a in range(first, first + length):
            rest = np.arange(a + 1, min((a - first) // BLOCK * BLOCK + first + BLOCK, first + length))
            parts = [rest]
            for b in range((a - first) // BLOCK + 1, len(blocks)):
                if DEN * size[a] < NUM * least[b]:
                    break  # all later sets are larger
                if min(reach[b], size[a] - position[a]) < -(-NUM * (size[a] + least[b]) // (NUM + DEN)) or lone[b] == group[a] != -1:
                    continue
                parts.append(np.arange(blocks[b], min(blocks[b] + BLOCK, first + length)))
            b = np.concatenate(parts)
            if len(b):
                keep(np.full(len(b), a), b)
        if len(out) > 2000:
            out[:] = [np.unique(np.concatenate(out), axis=0)]
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def list_stars(token: np.ndarray, node: np.ndarray, group: np.ndarray, size: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Pairs of each entry of a long inverted list with the entry of the fewest rare tokens, where groups differ."""
    order = np.lexsort((node, rare, token))
    token, node, group, size = token[order], node[order], group[order], size[order]
    firsts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(firsts, len(token)))
    head = np.repeat(firsts, lengths)
    good = (np.repeat(lengths, lengths) >= STAR_FROM) & (group != group[head]) & (DEN * np.minimum(size, size[head]) >= NUM * np.maximum(size, size[head]))
    x, y = node[good], node[head[good]]
    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)


def _candidates(sets: DataFrame, groups: DataFrame, buckets: int, stars: bool) -> DataFrame:
    """(src, dst): pairs of sets of different groups that share a prefix token and can reach the overlap; with stars,
    of the lists of frequent tokens the stars only."""
    fields = ["token", "entry", "place", "node", "grp", "size", "n_rare"]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        token = np.concatenate([r[0] for r in rows])
        lengths = np.array([len(r[0]) for r in rows])
        entry = np.repeat(np.arange(len(rows), dtype=np.uint32), lengths)
        place = np.minimum(np.concatenate([np.arange(n) for n in lengths]), 65535).astype(np.uint16)
        node, group, size, n_rare = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4))
        bucket = (mix(token.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((token, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = {f: [] for f in ["bucket", *fields]}
        for b in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[b] : cuts[b + 1]]
            used, entries = np.unique(entry[mine], return_inverse=True)
            for f, x in zip(["bucket", *fields], (b, _packed(token[mine]), entries.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), place[mine].tobytes(), node[used].tobytes(), group[used].tobytes(), size[used].tobytes(), n_rare[used].tobytes()), strict=True):
                out[f].append(x)
        return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), *(pa.array(out[f], pa.binary()) for f in fields)], ["bucket", *fields])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for rare, late, *about in zip(*(batch.column(c).to_pylist() for c in ("rare", "late", "node", "grp", "n", "n_rare")), strict=True):
                mine = _tokens(late) if stars else np.concatenate([_tokens(rare), _tokens(late)])
                rows.append((mine, *about))
                held += len(mine)
                if held > 2 << 20:
                    yield flush(rows)
                    rows, held = [], 0
        if held:
            yield flush(rows)

    def pairs(found: pa.Table) -> pa.Table:
        cols = [[] for _ in range(6)]
        for row in found.to_pylist():
            token = _tokens(row["token"])
            entry = np.frombuffer(row["entry"], np.uint16 if len(row["entry"]) == 2 * len(token) else np.uint32)
            node, group, size, rare = (np.frombuffer(row[f], np.int64) for f in ("node", "grp", "size", "n_rare"))
            for c, x in zip(cols, (token, node[entry], group[entry], size[entry], np.frombuffer(row["place"], np.uint16).astype(np.int64), rare[entry]), strict=True):
                c.append(x)
        *entries, place, rare = map(np.concatenate, cols)
        found = list_stars(*entries, rare) if stars else list_pairs(*entries, place)
        return pa.table({"src": pa.array(found[:, 0]), "dst": pa.array(found[:, 1])})

    grouped = sets.join(groups.select("node", F.col("root").alias("grp")), "node", "left").select("node", "n", "n_rare", "rare", "late", F.coalesce("grp", "node").alias("grp"))
    spreaded = grouped.mapInArrow(spread, "bucket long, " + ", ".join(f"{f} binary" for f in fields))
    return spreaded.groupBy("bucket").applyInArrow(pairs, "src long, dst long").distinct()


def _salts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, salts): the values of key columns that stand in more than KEY_ROWS rows, and the salts to deal them by."""
    values = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in keys))).alias("k"))
    many = values.groupBy("k.key", "k.value").count().filter(F.col("count") > KEY_ROWS)
    many = materialize(many.select("key", "value", F.ceil(F.col("count") / KEY_ROWS).cast("long").alias("salts")), "salts")
    return F.broadcast(many) if many.count() <= BROADCAST_ROWS else many


def _salted(rows: DataFrame, sides: DataFrame, key: str, salts: DataFrame) -> DataFrame:
    """rows joined with the one row that sides has for each key. Keys with many rows are dealt by salts, and their side is
    sent once for each salt."""
    mine = salts.filter(F.col("key") == key).select(F.col("value").alias("hot_key"), "salts")
    other = next(c for c in rows.columns if c != key)
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(other), F.col("salts"))).otherwise(0).cast("long").alias("salt")
    dealt = rows.join(mine, rows[key] == mine["hot_key"], "left").select(*(rows[c] for c in rows.columns), salt)
    each = sides.join(mine, sides[key] == mine["hot_key"], "left").select(*(sides[c] for c in sides.columns), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return dealt.join(each, [key, "salt"]).drop("salt")


def _whole_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, tokens): the whole sets of the wanted (node), each from the text of one document."""
    chosen = materialize(nodes.select("node", F.col("least").alias("chosen_id")).join(wanted, "node"), "chosen")
    ids = chosen.select("chosen_id").distinct()
    if chosen.count() <= BROADCAST_ROWS:
        ids, chosen = F.broadcast(ids), F.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, sets = [], [], []
            for _, found, node in _sets(batch, k):
                if node is not None:
                    nodes.append(node)
                    sizes.append(len(found))
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], ["node", "n", "tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["chosen_id"]), "left_semi").select("text")
    sets = texts.mapInArrow(run, "node long, n long, tokens binary").join(chosen, "node", "left_semi").dropDuplicates(["node"])
    return materialize(sets, "sets")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The pairs (src, dst) of nodes whose whole sets reach the similarity."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, a, b = (batch.column(c).to_pylist() for c in ("n", "m", "a", "b"))
            bound = [most_shared(x, y) for x, y in zip(a, b, strict=True)]
            good = [s is None or DEN * s >= NUM * (i + j - s) for s, i, j in zip(bound, n, m, strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    # Sizes and counts of classes rule out most pairs before whole sets are moved.
    pairs = materialize(pairs, "candidates")
    salts = _salts(pairs, ["src", "dst"])
    pairs = _salted(pairs, nodes.select(F.col("node").alias("src"), "n", F.col("counts").alias("a")), "src", salts)
    pairs = _salted(pairs.select("src", "dst", "n", "a"), nodes.select(F.col("node").alias("dst"), F.col("n").alias("m"), F.col("counts").alias("b")), "dst", salts)
    pairs = materialize(pairs.filter(f"{DEN} * least(n, m) >= {NUM} * greatest(n, m)").mapInArrow(likely, "src long, dst long"), "pairs")
    sets = _whole_sets(docs, nodes, pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), k)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = batch.column("src").to_pylist(), batch.column("dst").to_pylist()
            n, m = batch.column("n").to_pylist(), batch.column("m").to_pylist()
            good = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("a", "b"))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if DEN * shared >= NUM * (n[i] + m[i] - shared):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([src[i] for i in good], pa.int64()), pa.array([dst[i] for i in good], pa.int64())], ["src", "dst"])

    left = sets.select(F.col("node").alias("src"), "n", F.col("tokens").alias("a"))
    right = sets.select(F.col("node").alias("dst"), F.col("n").alias("m"), F.col("tokens").alias("b"))
    half = _salted(pairs, left, "src", salts).select("src", "dst", "n", "a")
    return materialize(_salted(half, right, "dst", salts).mapInArrow(verify, "src long, dst long"), "links")


def _linked(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features of all documents, (node, least, w, n, ...) of their sets: smallest doc_id, rows and size, and (node, root) of
    the sets that have links to others)."""
    spark = docs.sparkSession
    features = materialize(shingle_sets(docs, k), "features")
    about = [F.min("doc_id").alias("least"), F.count("*").alias("w"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("counts").alias("counts")]
    nodes = materialize(features.filter("node is not null").groupBy("node").agg(*about), "nodes")
    total = features.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_TOKENS))

    # Stars: each min-hash key sends its sets to the first and last of them, in two orders.
    keyed = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    mixed = F.xxhash64("node")
    ends = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min_by("node", mixed).alias("c"), F.max_by("node", mixed).alias("d")).filter("a <> b")
    leaders = ends.select("key", F.array_distinct(F.array("a", "b", "c", "d")).alias("leaders"))
    stars = keyed.join(leaders, "key").select(F.col("node").alias("src"), F.explode("leaders").alias("dst")).filter("src <> dst")
    stars = stars.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    links = _verified(docs, nodes, stars, k)
    groups = connected_components(links)

    frequent = spark.sparkContext.broadcast(_frequent(docs, k, buckets))
    sets = materialize(_prefixes(docs, frequent, k), "prefixes")
    for stars in (True, False):
        links = links.unionByName(_verified(docs, nodes, _candidates(sets, groups, buckets, stars), k))
        groups = connected_components(links)
    return features, nodes, groups


def _components(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, w, component_id) of every node."""
    labelled = nodes.join(groups, "node", "left").select("node", "w", "least", F.coalesce("root", "node").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return labelled.join(smallest, "root").select("node", "w", "component_id")


def _of_rows(features: DataFrame, nodes: DataFrame, by_node: DataFrame, columns: list) -> DataFrame:
    """columns of every row, each with its node's. Copies of one text are dealt by salts."""
    hot = nodes.filter(F.col("w") > KEY_ROWS).select(F.lit("node").alias("key"), F.col("node").alias("value"), F.ceil(F.col("w") / KEY_ROWS).cast("long").alias("salts"))
    if hot.count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    found = _salted(features.filter("node is not null").select("doc_id", "node", "n_shingles"), by_node, "node", hot)
    empty = features.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return found.select(*columns).unionByName(empty.select(*columns))


def jaccard_components(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text). See the module's docstring."""
    features, nodes, groups = _linked(docs, k)
    return _of_rows(features, nodes, _components(nodes, groups), ["doc_id", "n_shingles", "component_id"])


def count_pairs(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the links of each member of a to those of b, and the other way round; without b, among a.

    A block has n (sizes of sets), w (rows of each), d (sizes of differences to the head) and diff (sorted, joined)."""
    other = a if b is None else b
    place = [np.repeat(np.arange(len(x["d"])), x["d"]) for x in (a, other)]
    shared = np.intersect1d(a["diff"], other["diff"])
    near = np.zeros((len(a["d"]), len(other["d"])), np.float32)
    for lo in range(0, len(shared), 4096):
        sides = []
        for x, rows in zip((a, other), place, strict=True):
            some = shared[lo : lo + 4096]
            at = np.minimum(np.searchsorted(some, x["diff"]), len(some) - 1)
            hit = some[at] == x["diff"]
            side = np.zeros((len(x["d"]), len(some)), np.float32)
            side[rows[hit], at[hit]] = 1
            sides.append(side)
        near += sides[0] @ sides[1].T
    apart = a["d"][:, None] + other["d"][None, :] - 2 * near.astype(np.int64)
    linked = (DEN + NUM) * apart <= (DEN - NUM) * (a["n"][:, None] + other["n"][None, :])
    if b is None:
        np.fill_diagonal(linked, False)
    return linked @ other["w"], a["w"] @ linked


def link_counts(docs: DataFrame, nodes: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(node, linked): the rows of other nodes that each node with a link is linked with."""
    members = materialize(groups.join(nodes.select("node", "w", "n"), "node"), "members")
    # The set that stands most often is likely the one that the others were made from.
    heads = members.groupBy("root").agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("node"))
    sets = _whole_sets(docs, nodes, members.select("node"), k)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.setxor1d(*(np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("tokens", "head")), assume_unique=True) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), batch.column("n"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["root", "node", "n", "d", "diff"])

    near = members.select("node", "root").join(sets, "node").select("node", "root", "n", "tokens")
    near = _salted(near, heads.join(sets.select("node", F.col("tokens").alias("head")), "node").select("root", "head"), "root", _salts(members, ["root"]))
    near = near.mapInArrow(differences, "root long, node long, n long, d long, diff binary").join(members.select("node", "w"), "node")
    # (DEN + NUM) * |D| - (DEN - NUM) * n: two members whose levels sum to 0 or less are linked whatever they share.
    level = (DEN + NUM) * F.col("d") - (DEN - NUM) * F.col("n")
    near = materialize(near.withColumn("level", level), "differences")

    # Blocks of members by level: a histogram of levels is cut by the sum of differences, a level that is too large by salts.
    steps = near.groupBy("root", "level").agg(F.sum(F.col("d") + 64).alias("size"))
    before = F.sum("size").over(Window.partitionBy("root").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    steps = steps.select("root", "level", F.floor(before / BLOCK_TOKENS).alias("step"), F.ceil(F.col("size") / BLOCK_TOKENS).alias("cuts"))
    near = near.join(steps, ["root", "level"])
    near = near.withColumn("cut", F.when(F.col("cuts") > 1, F.struct(F.col("level"), F.pmod(F.xxhash64("node"), "cuts").alias("part"))))
    near = materialize(near.withColumn("block", F.xxhash64("root", "step", "cut")).drop("step", "cuts", "cut"), "blocked")
    about = [F.min("level").alias("least"), F.max("level").alias("most"), F.min("d").alias("d0"), F.max("d").alias("d1"), F.max("n").alias("n1"), F.sum("w").alias("rows")]
    blocks = materialize(near.groupBy("root", "block").agg(*about), "blocks")
    one, two = (blocks.select("root", *(F.col(c).alias(f"{c}_{x}") for c in blocks.columns if c != "root")) for x in "ab")
    pairs = one.join(two, "root").filter("block_a <= block_b")
    sure = F.col("most_a") + F.col("most_b") <= 0
    gap = F.greatest(F.col("d0_a") - F.col("d1_b"), F.col("d0_b") - F.col("d1_a"))
    open_pairs = pairs.filter(~sure & ((DEN + NUM) * gap <= (DEN - NUM) * (F.col("n1_a") + F.col("n1_b"))))
    both = F.expr("inline(array(named_struct('block', block_a, 'more', rows_b), named_struct('block', if(block_a = block_b, null, block_b), 'more', rows_a)))")
    settled = pairs.filter(sure).select(both).filter("block is not null").groupBy("block").agg(F.sum("more").alias("more"), F.count("*").alias("n_pairs"))
    # A block that is sure with itself counts each member's own rows: they are taken off again.
    own = pairs.filter(sure & (F.col("block_a") == F.col("block_b"))).select(F.col("block_a").alias("block"), F.lit(1).alias("own"))
    settled = settled.join(own, "block", "left")
    certain = near.select("node", "w", "block").join(settled, "block").select("node", (F.col("more") - F.when(F.col("own") == 1, F.col("w")).otherwise(0)).alias("linked"))

    packed = near.groupBy("block").agg(F.collect_list(F.struct("node", "n", "w", "d", "diff")).alias("rows"))  # BLOCK_TOKENS at most, or one member
    wanted = open_pairs.select("block_a", "block_b").distinct()
    tasks = wanted.join(packed.select(F.col("block").alias("block_a"), F.col("rows").alias("a")), "block_a")
    tasks = tasks.join(packed.select(F.col("block").alias("block_b"), F.col("rows").alias("b")), "block_b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.ListScalar) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            values = rows.values
            node, n, w, d = (values.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "w", "d"))
            return node, {"n": n, "w": w, "d": d, "diff": np.frombuffer(b"".join(values.field("diff").to_pylist()), np.uint64)}

        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column("block_a")[i] == batch.column("block_b")[i]
                (node, a), (other, b) = block(batch.column("a")[i]), block(batch.column("b")[i])
                mine, theirs = count_pairs(a, None if same else b)
                nodes, links = (node, mine) if same else (np.concatenate([node, other]), np.concatenate([mine, theirs]))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links.astype(np.int64))], ["node", "linked"])

    counted = tasks.select("block_a", "block_b", "a", "b").mapInArrow(count, "node long, linked long")
    return certain.unionByName(counted).groupBy("node").agg(F.sum("linked").alias("linked"))


def jaccard_links(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of docs (doc_id, text): the rows of docs that it is linked
    with, equal ones included. See the module's docstring."""
    features, nodes, groups = _linked(docs, k)
    by_node = _components(nodes, groups).join(link_counts(docs, nodes, groups, k), "node", "left")
    by_node = by_node.select("node", "component_id", (F.col("w") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return _of_rows(features, nodes, by_node, ["doc_id", "n_shingles", "component_id", "n_links"])


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that are linked, directly or through others, to one of a smaller doc_id. Rows of one
    doc_id and equal text count as one document; rows without an id can't be named
    and always stay."""
    found = materialize(jaccard_components(docs), "components")
    dropped = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id")).distinct()
    again = found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select(F.col("doc_id").alias("again_id"))
    dropped, again = materialize(dropped, "dropped"), materialize(again, "again")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    kept = docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")
    if again.isEmpty():
        return kept
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    same = docs["doc_id"] == again["again_id"]
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
