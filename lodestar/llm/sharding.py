"""Consistent-hash sharding with virtual nodes and bounded loads.

Shards own virtual nodes on a ring of CELLS cells; a row's key hashes to a cell, and its home is the shard of the next
virtual node clockwise. Loads are bounded: of n rows in k shards each shard takes n // k, and the first n % k in a
hashed order take one more, so counts differ by one at most. Rows that a full shard can't take continue clockwise to
the next shard that has room; all rows try their home first, then all overflowing rows the next shard, and so on, so no
more rows move than must.

The rows of a cell are alike to the ring, so the walk is planned on the counts of cells (CELLS numbers at most, whatever
the size of the table); a row then finds its shard and slot by its rank in its cell. Everything is DataFrame functions.

Edge cases: null doc_id or text are values of the key like any others (a null text has size 8 and the checksum of an
empty one); rows with equal doc_id and text are counted before they are ranked, and each gets its own slot; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import json_rows

#: Cells of the ring and virtual nodes of a shard.
CELLS, VIRTUAL_NODES = 1 << 13, 64


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big")


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in ring order."""
    return sorted((_hash("node", s, v) % CELLS, _hash("order", s, v), s) for s in range(shards) for v in range(virtual_nodes))


def capacities(n: int, shards: int) -> list[int]:
    """The bound of each shard; they sum to n and differ by one at most."""
    longer = set(sorted(range(shards), key=lambda s: _hash("longer", s))[: n % shards])
    return [n // shards + (s in longer) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot, home) that deal the rows of each cell clockwise within the bounds."""
    nodes = ring(shards, virtual_nodes)
    room, used = capacities(sum(counts.values()), shards), [0] * shards
    cells = [c for c, *_ in nodes]
    left, taken, out = dict(sorted(counts.items())), dict.fromkeys(counts, 0), []
    preferences: dict[int, list[int]] = {}
    for cell in left:
        at = bisect.bisect_left(cells, cell)
        preferences[cell] = list(dict.fromkeys(nodes[(at + i) % len(nodes)][2] for i in range(len(nodes))))
    for choice in range(shards):
        for cell in [c for c, n in left.items() if n]:
            shard = preferences[cell][choice]
            n = min(left[cell], room[shard] - used[shard])
            if n > 0:
                out.append((cell, taken[cell], taken[cell] + n, shard, used[shard], preferences[cell][0]))
                left[cell] -= n
                taken[cell] += n
                used[shard] += n
    return out


def shard_rows(docs: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, home_shard) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    alike = alike.withColumn("point", F.xxhash64("doc_id", "size", "text_crc32")).withColumn("cell", F.pmod("point", F.lit(CELLS)).cast("int"))
    counts = {r["cell"]: r["n"] for r in rows.groupBy(F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(CELLS)).cast("int").alias("cell")).agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    segments = json_rows(spark, json.dumps([dict(zip("cabsfh", x, strict=True)) for x in walk(counts, shards, virtual_nodes)]), "c int, a long, b long, s int, f long, h int")
    segments = F.broadcast(segments.select(F.col("c").alias("cell"), "a", "b", "s", "f", "h"))  # CELLS + shards ** 2 rows at most
    ends = F.sum("n").over(Window.partitionBy("cell").orderBy("point", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0))
    ranked = alike.withColumn("end", ends).withColumn("first", F.col("end") - F.col("n"))
    joined = ranked.join(segments, (ranked["cell"] == segments["cell"]) & (F.col("first") < F.col("b")) & (F.col("end") > F.col("a")))
    span = F.sequence(F.greatest("first", "a"), F.least("end", "b") - 1)
    return joined.select("doc_id", "size", "text_crc32", F.col("s").alias("shard"), F.col("f"), F.col("a"), F.col("h").alias("home_shard"), F.explode(span).alias("rank")).select("doc_id", "size", "text_crc32", "shard", (F.col("f") + F.col("rank") - F.col("a")).alias("slot"), "home_shard")
