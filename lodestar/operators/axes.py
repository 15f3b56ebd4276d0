"""Semantic axes of the tag space: spherical k-means, weighted principal axes, projection and resonance."""

from __future__ import annotations

from collections.abc import Iterator

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import Axes
from lodestar.tables import written


@dataclass
class Basis:
    mean: np.ndarray
    axes: np.ndarray  # a row for each axis
    energies: np.ndarray
    labels: list[str]


def train(tags: DataFrame, c: Axes = Axes()) -> Basis | None:
    """Axes of tags (tag_id, name, vector), or None with fewer than min_tags vectors.

    Tags are assigned to the centroid of the largest dot product in a distributed pass for each step; what reaches the
    driver are sums of at most `clusters` vectors. The first centroids are the tags of the smallest hash, so training gives
    the same axes each time.
    """
    known = written(tags.filter("vector is not null").select("tag_id", "name", F.col("vector").cast("array<double>").alias("vector")), "axis-tags")
    n = known.count()
    if n < c.min_tags:
        return None
    k = min(n, c.clusters)
    first = known.orderBy(F.xxhash64("tag_id", F.lit(c.seed)), "tag_id").limit(k).collect()
    centroids = np.array([r["vector"] for r in first])
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    sizes = np.ones(k)
    for _ in range(50):
        flat = F.lit(centroids.ravel().tolist())
        dim = centroids.shape[1]
        scores = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.aggregate(F.zip_with(F.col("vector"), F.slice(flat, i * dim + 1, F.lit(dim)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
        nearest = known.withColumn("s", scores).select((F.array_position("s", F.array_max("s")) - 1).cast("int").alias("c"), "vector")
        sums = nearest.mapInArrow(_sums, "c int, n long, sums array<double>").select("c", "n", F.posexplode("sums").alias("pos", "s"))
        sums = sums.groupBy("c", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # clusters x dimension
        fresh, sizes = np.zeros_like(centroids), np.zeros(k)
        for r in sums:
            fresh[r["c"], r["pos"]] = r["s"]
            sizes[r["c"]] = r["n"]
        norms = np.linalg.norm(fresh, axis=1)
        usable = (sizes > 0) & (norms > 0)
        fresh[usable] /= norms[usable, None]
        fresh[~usable] = centroids[~usable]
        moved = ((fresh - centroids) ** 2).sum()
        centroids = fresh
        if moved < 1e-4:
            break
    score = lambda row: F.aggregate(F.zip_with(F.col("vector"), F.lit(row.tolist()), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    nearest = known.agg(*(F.max_by("name", F.struct(score(row), -F.col("tag_id"))).alias(f"c{i}") for i, row in enumerate(centroids))).first()
    names = list(nearest)
    return principal_axes(centroids, sizes, names, c)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, n, sums) of rows (c, vector): one row for each cluster of a task."""
    found: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column("c").to_numpy()
        rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        for k in np.unique(c):
            mine = found.setdefault(int(k), [0, np.zeros(rows.shape[1])])
            mine[0] += int((c == k).sum())
            mine[1] += rows[c == k].sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([s.tolist() for _, s in found.values()], pa.list_(pa.float64()))], ["c", "n", "sums"])


def principal_axes(centroids: np.ndarray, sizes: np.ndarray, names: list[str], c: Axes = Axes()) -> Basis:
    """Weighted principal axes through the small Gram matrix of the centroids."""
    weights = sizes / max(sizes.sum(), 1)
    mean = weights @ centroids
    rows = np.sqrt(sizes)[:, None] * (centroids - mean)
    values, vectors = np.linalg.eigh(rows @ rows.T)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    good = values > 1e-6
    values, vectors = values[good][: c.max_basis], vectors[:, good][:, : c.max_basis]
    axes = (rows.T @ vectors).T
    axes /= np.maximum(np.linalg.norm(axes, axis=1, keepdims=True), 1e-12)
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    reach = int(np.argmax(share > c.cumulative)) + 1 if (share > c.cumulative).any() else len(values)
    keep = min(max(reach, c.min_basis), len(values))
    return Basis(mean, axes[:keep], values[:keep], names[:keep])


def project(queries: DataFrame, basis: Basis, c: Axes = Axes()) -> DataFrame:
    """queries (query_id, vector) with projections, probabilities, entropy, depth and dominant axes (axis, energy,
    projection). A query without energy on the axes has entropy 1, depth 0 and no axes."""
    k, mean = len(basis.axes), F.lit(basis.mean.tolist())
    centred = F.zip_with(F.col("vector"), mean, lambda x, m: x.cast("double") - m)
    dots = F.array(*(F.aggregate(F.zip_with(F.col("centred"), F.lit(a.tolist()), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for a in basis.axes)) if k else F.array().cast("array<double>")
    out = queries.withColumn("centred", centred).withColumn("projections", dots).drop("centred")
    return with_spectrum(out, k, c)


def with_spectrum(rows: DataFrame, k: int, c: Axes = Axes()) -> DataFrame:
    """rows with the array projections gain probabilities, entropy, depth and dominant."""
    energy = F.aggregate("projections", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.withColumn("total", energy)
    some = F.col("total") >= 1e-12
    shares = F.when(some, F.transform("projections", lambda x: x * x / F.col("total"))).otherwise(F.transform("projections", lambda x: F.lit(0.0)))
    rows = rows.withColumn("probabilities", shares)
    bits = F.aggregate("probabilities", F.lit(0.0), lambda s, p: s - F.when(p > 1e-9, p * F.log2(p)).otherwise(0.0))
    entropy = F.when(~some, 1.0).when(F.lit(k) > 1, bits / float(np.log2(max(k, 2)))).otherwise(0.0)
    strong = F.filter(F.transform("probabilities", lambda p, i: F.struct((-p).alias("key"), i.alias("axis"), p.alias("energy"), F.get("projections", i).alias("projection"))), lambda a: a["energy"] > c.dominant)
    dominant = F.transform(F.array_sort(strong), lambda a: F.struct(a["axis"], a["energy"], a["projection"]))
    return rows.withColumn("entropy", entropy).withColumn("depth", 1 - F.col("entropy")).withColumn("dominant", dominant).drop("total")


def resonance(dominant: Column, c: Axes = Axes()) -> Column:
    """The summed strength of bridges between the strongest axis and the others: sqrt(E1 * Ei) above the bound."""
    top = F.get(dominant, F.lit(0))["energy"]
    others = F.slice(dominant, 2, F.greatest(F.size(dominant) - 1, F.lit(0)))
    strength = lambda a: F.sqrt(top * a["energy"])
    return F.when(F.size(dominant) < 2, 0.0).otherwise(F.aggregate(others, F.lit(0.0), lambda s, a: s + F.when(strength(a) > c.bridge, strength(a)).otherwise(0.0)))
