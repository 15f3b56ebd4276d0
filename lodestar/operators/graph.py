"""The ordered tag co-occurrence graph and its propagation kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import Cooccurrence, Kernel
from lodestar.functions import vec
from lodestar.tables import written


def occurrences(rows: DataFrame) -> DataFrame:
    """(file, tag_id, pos, n) of rows (file, tag_id, pos): n counts the file's occurrences, repeats included."""
    return rows.select("file", "tag_id", "pos", F.count("*").over(Window.partitionBy("file")).alias("n"))


def pair_evidence(occ: DataFrame, c: Cooccurrence = Cooccurrence()) -> DataFrame:
    """(src, dst, evidence, pairs): the summed phi * phi * decay of all places where src stands before dst in a file."""
    a = occ.select("file", F.col("tag_id").alias("src"), F.col("pos").alias("p"), vec.phi(F.col("pos"), F.col("n"), c).alias("wa"))
    b = occ.select("file", F.col("tag_id").alias("dst"), F.col("pos").alias("q"), vec.phi(F.col("pos"), F.col("n"), c).alias("wb"))
    joined = a.join(b, "file").filter("p < q and src <> dst")
    base = F.col("wa") * F.col("wb") * vec.distance_decay(F.col("q") - F.col("p"), c)
    return joined.groupBy("src", "dst").agg(F.sum(base).alias("evidence"), F.count("*").alias("pairs"))


def fact_matrix(occ: DataFrame, vectors: DataFrame, c: Cooccurrence = Cooccurrence(), evidence: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight): directed edges.

    Every pair gives its evidence forwards and, times the reverse factor, backwards; the guard keeps the backward share
    of a pair at or below inversion_guard of its forward share. Both shares are the same multiple of a pair's evidence, so
    the evidence of each direction is summed first, and the similarity of two tags is computed once for each pair of tags
    that occur together. vectors: (tag_id, vector). evidence: that of pair_evidence, where it is at hand.
    """
    back = min(max(c.reverse_min, min(c.reverse_max, c.reverse)), c.inversion_guard * c.forward)
    found = pair_evidence(occ, c) if evidence is None else evidence
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    up = F.sum(F.when(F.col("src") < F.col("dst"), F.col("evidence")).otherwise(0.0)).alias("up")
    down = F.sum(F.when(F.col("src") > F.col("dst"), F.col("evidence")).otherwise(0.0)).alias("down")
    both = found.groupBy(a, b).agg(up, down)
    va = vectors.select(F.col("tag_id").alias("a"), F.col("vector").alias("va"))
    vb = vectors.select(F.col("tag_id").alias("b"), F.col("vector").alias("vb"))
    gain = vec.semantic_gain(vec.cosine_or_null(F.col("va"), F.col("vb")), c)
    both = both.join(va, "a", "left").join(vb, "b", "left").select("a", "b", "up", "down", gain.alias("gain"))
    edge = lambda x, y, fwd, rev: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), (F.col("gain") * (c.forward * F.col(fwd) + back * F.col(rev))).alias("weight"))
    edges = both.select(F.inline(F.array(edge("a", "b", "up", "down"), edge("b", "a", "down", "up"))))
    return edges.filter("weight > 0 and not isnan(weight) and weight < double('infinity')")


def fact_diagnostics(occ: DataFrame, vectors: DataFrame, c: Cooccurrence = Cooccurrence()) -> DataFrame:
    """One row: files with two or more occurrences and their pairs of places, the edges that those gave forwards and
    backwards (pairs of one tag give none), the backward ones that the guard cut, and the distinct edges."""
    evidence = written(pair_evidence(occ, c), "evidence")
    fact = fact_matrix(occ, vectors, c, evidence)
    files = occ.groupBy("file").agg(F.max("n").alias("n")).filter("n >= 2").agg(F.count("*").alias("files"), F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("pairs"))
    back = min(c.reverse_max, max(c.reverse_min, c.reverse))
    given = F.coalesce(F.sum("pairs"), F.lit(0))
    counts = evidence.agg(given.alias("forward_edges"), given.alias("backward_edges"), (given if back > c.inversion_guard * c.forward else F.lit(0)).cast("long").alias("inversion_clamped"))
    return files.crossJoin(counts).crossJoin(fact.agg(F.count("*").alias("edges")))  # one row each


def conductance(fact: DataFrame, residual: DataFrame | None = None, k: Kernel = Kernel()) -> DataFrame:
    """(src, dst, g, is_wormhole): compressed evidence, raised on strong edges. residual: (tag_id, residual), else 1."""
    k = k.clamped()
    rows = fact.withColumn("e", F.log1p(F.greatest("weight", F.lit(0.0)) * k.compression))
    r = F.lit(1.0)
    if residual is not None:
        rows = rows.join(residual.select(F.col("tag_id").alias("dst"), "residual"), "dst", "left")
        r = F.coalesce("residual", F.lit(1.0))
    strong = F.col("e") * r >= k.tension
    return rows.select("src", "dst", (F.col("e") * F.when(strong, k.wormhole_gain).otherwise(1.0)).alias("g"), strong.alias("is_wormhole")).filter("g > 0")


def inflows(edges: DataFrame) -> DataFrame:
    """(dst, inflow) of (src, dst, g)."""
    return edges.groupBy("dst").agg(F.sum("g").alias("inflow"))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """One row (median): the value at place n // 2 (from 0) of the sorted ones, 1 where there is none.

    One task holds the distinct values with their counts: one number for each tag that has inflow."""
    counts = values.groupBy(column).count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    pick = counts.agg(F.percentile(F.col(column), F.lit(0.5), F.col("count")).alias("near"))
    # percentile interpolates between the two middle values; the upper one is the least value not below it.
    upper = counts.crossJoin(F.broadcast(pick)).filter(F.col(column) >= F.col("near")).agg(F.min(column).alias("upper"))
    return total.crossJoin(upper).select(F.coalesce("upper", F.lit(1.0)).alias("median"))


def kernel(fact: DataFrame, residual: DataFrame | None = None, k: Kernel = Kernel()) -> DataFrame:
    """(src, dst, p, is_wormhole): rows sum to outbound; hubs, whose inflow is above the upper median, are damped."""
    k = k.clamped()
    edges = written(conductance(fact, residual, k), "conductance")  # stands below three times
    inflow = written(inflows(edges), "inflow")
    edges = edges.join(inflow, "dst").crossJoin(F.broadcast(upper_median(inflow, "inflow")))  # one row
    relative = F.col("inflow") / (F.col("median") + F.greatest(F.lit(1e-9), F.col("median") * k.hub_smoothing))
    penalty = F.greatest(F.lit(k.hub_floor), F.least(F.lit(k.hub_ceiling), F.pow(F.greatest(relative, F.lit(1e-9)), -k.hub_exponent)))
    edges = edges.withColumn("h", F.col("g") * penalty).filter("h > 0")
    row = Window.partitionBy("src")
    edges = edges.withColumn("total", F.sum("h").over(row)).withColumn("strong", F.sum(F.when(F.col("is_wormhole"), F.col("h"))).over(row))
    reserve = F.when(F.col("strong") > 0, k.reserve).otherwise(0.0)
    extra = F.when(F.col("is_wormhole"), reserve * F.col("h") / F.col("strong")).otherwise(0.0)
    return edges.select("src", "dst", ((k.outbound - reserve) * F.col("h") / F.col("total") + extra).alias("p"), "is_wormhole")


def neighbours(edges: DataFrame, fan_out: int = 20) -> DataFrame:
    """(src, dst, p, is_wormhole, rank): the fan_out strongest edges of each node, ties by dst."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("p"), "dst")).cast("long")
    return edges.withColumn("rank", rank).filter(F.col("rank") <= fan_out)
