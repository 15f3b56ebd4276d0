"""Soft non-backtracking propagation of seeds over the kernel, for all queries at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import Spread
from lodestar.functions.vec import fir_weights
from lodestar.operators.graph import neighbours
from lodestar.tables import written


def hop(states: DataFrame, top: DataFrame, s: Spread = Spread()) -> DataFrame:
    """The states after one hop. States: (query_id, prev, node, energy, momentum, source_type).

    A state fires with an energy of firing or more over its node's strongest edges; a step back to where it came from is
    damped; small currents, and states without momentum that meet no wormhole, end. States that reach a node from the same
    node are one. Each query keeps its max_states strongest.
    """
    edges = top.select(F.col("src").alias("node"), F.col("dst").alias("next"), "p", "is_wormhole")
    current = F.col("energy") * F.col("p") * F.when(F.col("is_wormhole"), s.wormhole_decay).otherwise(s.decay)
    back = F.when(F.col("next").eqNullSafe(F.col("prev")), s.return_flow).otherwise(1.0)
    left = F.col("momentum") - F.when(F.col("is_wormhole"), 0).otherwise(1)
    moved = states.filter((F.col("energy") >= s.firing) & (F.col("momentum") >= 0)).join(edges, "node")
    moved = moved.select("query_id", F.col("node").alias("prev"), F.col("next").alias("node"), (current * back).alias("energy"), left.alias("momentum"), "source_type", "is_wormhole", (current - current * back).alias("suppressed"))
    moved = moved.filter((F.col("energy") >= s.least) & ((F.col("momentum") >= 0) | F.col("is_wormhole")))
    merged = moved.groupBy("query_id", "prev", "node").agg(F.sum("energy").alias("energy"), F.max("momentum").alias("momentum"), F.min("source_type").alias("source_type"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("energy"), "prev", "node"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= s.max_states).drop("rank")


def hop_diagnostics(states: DataFrame, top: DataFrame, s: Spread = Spread()) -> DataFrame:
    """(query_id, in_flight, truncated) of a hop from these states: the energy of the states after it, and how many states
    fell to the bound of max_states."""
    kept = hop(states, top, s).groupBy("query_id").agg(F.sum("energy").alias("in_flight"), F.count("*").alias("kept"))
    every = hop(states, top, replace(s, max_states=(1 << 31) - 1)).groupBy("query_id").agg(F.count("*").alias("every"))
    return kept.join(every, "query_id").select("query_id", "in_flight", (F.col("every") - F.col("kept")).alias("truncated"))


def propagate(seeds: DataFrame, kernel: DataFrame, s: Spread = Spread()) -> DataFrame:
    """(query_id, node, energy, hop, source_type, origin_type) of seeds (query_id, node, weight, is_core).

    Energies of hop h count times the h-th tap of the smoothing filter. hop, source_type and origin_type tell where a node
    first appeared: core or seed at hop 0, else emergent with the source of the states that reached it. A query ends when
    no node of a hop has more than `least`; that last hop still counts.
    """
    taps = fir_weights(s.hops, s.gamma)
    top = written(neighbours(kernel, s.fan_out), "neighbours")
    kind = F.when(F.col("is_core"), "core").otherwise("seed")
    states = seeds.select("query_id", F.lit(None).cast("long").alias("prev"), F.col("node").cast("long").alias("node"), F.col("weight").cast("double").alias("energy"), F.lit(s.momentum).alias("momentum"), kind.alias("source_type"))
    field = states.select("query_id", "node", (F.col("energy") * taps[0]).alias("energy"), F.lit(0).alias("hop"), "source_type", F.lit(None).cast("string").alias("origin_type"))
    for h in range(1, s.hops + 1):
        reached = written(hop(states, top, s), f"hop{h}")
        by_node = reached.groupBy("query_id", "node").agg(F.sum("energy").alias("total"), F.min("source_type").alias("origin_type"))
        field = field.unionByName(by_node.select("query_id", "node", (F.col("total") * taps[h]).alias("energy"), F.lit(h).alias("hop"), F.lit("emergent").alias("source_type"), "origin_type"))
        alive = by_node.filter(F.col("total") > s.least).select("query_id").distinct()
        states = reached.join(alive, "query_id", "left_semi")
    first = lambda c: F.min_by(c, "hop").alias(c)
    return field.groupBy("query_id", "node").agg(F.sum("energy").alias("energy"), F.min("hop").alias("hop"), first("source_type"), first("origin_type"))


def suppressed_mass(states: DataFrame, top: DataFrame, s: Spread = Spread()) -> DataFrame:
    """(query_id, suppressed): the return flow that a hop from these states damps, counted before small currents end."""
    edges = top.select(F.col("src").alias("node"), F.col("dst").alias("prev"), "p", "is_wormhole")
    current = F.col("energy") * F.col("p") * F.when(F.col("is_wormhole"), s.wormhole_decay).otherwise(s.decay)
    fired = states.filter((F.col("energy") >= s.firing) & (F.col("momentum") >= 0) & F.col("prev").isNotNull())
    return fired.join(edges, ["node", "prev"]).groupBy("query_id").agg(F.sum(current * (1 - s.return_flow)).alias("suppressed"))
