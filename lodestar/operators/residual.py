"""Residual pyramid: explain a query vector by its nearest tags, level after level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.config import Residual
from lodestar.operators.similarity import top_k
from lodestar.tables import written

LEVEL = "query_id long, level int, energy0 double, explained double, ratio double, coherence double, pattern double, noise double, residual array<double>, tags array<struct<tag_id:bigint,rank:int,similarity:double,contribution:double,handshake:double>>"


def orthogonal(residual: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new residual, contribution of each vector) by modified Gram-Schmidt in the given order."""
    basis: list[np.ndarray] = []
    contribution = np.zeros(len(vectors))
    for i, v in enumerate(vectors):
        v = v.astype(float).copy()
        for b in basis:
            v -= (v @ b) * b
        if (size := np.linalg.norm(v)) > 1e-6:
            basis.append(v / size)
            contribution[i] = abs(float(residual @ basis[-1]))
    rest = residual.astype(float).copy()
    for b in basis:
        rest -= (residual @ b) * b
    return rest, contribution


def handshake(residual: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """(lengths of the differences, coherence, pattern of the first five, noise)."""
    delta = residual[None, :] - vectors
    size = np.linalg.norm(delta, axis=1)
    direction = np.where(size[:, None] > 1e-9, delta / np.maximum(size[:, None], 1e-300), 0.0)
    coherence = float(np.linalg.norm(direction.mean(axis=0)))
    first = direction[:5]
    pairs = np.abs(first @ first.T)[np.triu_indices(len(first), 1)]
    pattern = float(pairs.mean()) if len(pairs) else 0.0
    return size, coherence, pattern, (1 - coherence) * (1 - pattern)


def pyramid(queries: DataFrame, tags: DataFrame, c: Residual = Residual()) -> DataFrame:
    """A row for each query (query_id, vector) and level, see LEVEL. tags: (tag_id, vector).

    A level takes the top_k tags nearest to the residual by cosine, removes what they span, and ends the query when less
    than min_energy of its energy is left. Queries without energy have no level.
    """
    live = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    live = live.withColumn("energy0", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).filter("energy0 >= 1e-12")
    out = None
    for level in range(c.levels):
        near = top_k(live, tags.select(F.col("tag_id").alias("item_id"), "vector"), c.top_k, cosine=True)
        found = near.join(tags.select(F.col("tag_id").alias("item_id"), F.col("vector").cast("array<double>").alias("tag_vector")), "item_id")
        listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score", "tag_vector"))).alias("near"))  # top_k at most
        rows = live.join(listed, "query_id").select("query_id", "vector", "energy0", "near")

        def run(batches: Iterator[pd.DataFrame], level=level) -> Iterator[pd.DataFrame]:
            for batch in batches:
                done = []
                for r in batch.itertuples():
                    vectors, now = np.array([list(t["tag_vector"]) for t in r.near]), np.array(r.vector, float)
                    rest, contribution = orthogonal(now, vectors)
                    lengths, coherence, pattern, noise = handshake(now, vectors)
                    left = float(rest @ rest)
                    marks = [{"tag_id": t["item_id"], "rank": t["rank"], "similarity": t["score"], "contribution": float(contribution[i]), "handshake": float(lengths[i])} for i, t in enumerate(r.near)]
                    done.append((r.query_id, level, r.energy0, max(0.0, float(now @ now) - left) / r.energy0, left / r.energy0, coherence, pattern, noise, rest.tolist(), marks))
                yield pd.DataFrame(done, columns=[x.split()[0] for x in LEVEL.split(", ")])

        reached = written(rows.mapInPandas(run, LEVEL), f"level{level}")
        out = reached if out is None else out.unionByName(reached)
        live = reached.filter(F.col("ratio") >= c.min_energy).select("query_id", F.col("residual").alias("vector"), "energy0")
    return out


def features(queries: DataFrame, levels: DataFrame) -> DataFrame:
    """(query_id, pyramid_depth, coverage, novelty, coherence, activation); a query without levels has 0, 0, 1, 0, 0."""
    first = lambda c: F.max(F.when(F.col("level") == 0, F.col(c))).alias(c)
    by = levels.groupBy("query_id").agg(F.count("*").alias("pyramid_depth"), F.least(F.lit(1.0), F.sum("explained")).alias("coverage"), F.max(F.when(F.col("level") == 0, F.col("coherence"))).alias("direction"), first("pattern"), first("noise"))
    rows = queries.select("query_id").join(by, "query_id", "left")
    zero = lambda c, x=0.0: F.coalesce(c, F.lit(x))
    return rows.select("query_id", zero("pyramid_depth", 0).alias("pyramid_depth"), zero("coverage").alias("coverage"), zero(0.7 * (1 - F.col("coverage")) + 0.3 * F.col("direction"), 1.0).alias("novelty"), zero("pattern").alias("coherence"), zero(F.col("coverage") * F.col("pattern") * (1 - F.col("noise"))).alias("activation"))
