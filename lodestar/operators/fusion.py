"""Query fusion: seeds of the pyramid, spread over the graph, make a context vector that the query is shifted towards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.functions import vec
from lodestar.functions.text import is_technical, notation
from lodestar.operators.dedup import tag_dedup


def seeds(levels: DataFrame, boosts: DataFrame, tags: DataFrame, cores: DataFrame) -> DataFrame:
    """(query_id, tag_id, weight, is_core, level): each tag at its first level; a core tag, named in cores (query_id, name)
    whatever the case, is raised by the query's core_boost."""
    each = levels.select("query_id", "level", F.inline("tags")).join(tags.select("tag_id", "name"), "tag_id", "left")
    first = F.row_number().over(Window.partitionBy("query_id", "tag_id").orderBy("level", "rank"))
    each = each.withColumn("first", first).filter(F.col("first") == 1)
    named = cores.select("query_id", F.lower("name").alias("low"), F.lit(True).alias("core")).distinct()
    each = each.withColumn("low", F.lower("name")).join(named, ["query_id", "low"], "left").join(boosts.select("query_id", "core_boost"), "query_id")
    core = F.coalesce("core", F.lit(False))
    near = F.when(F.coalesce("similarity", F.lit(0.0)) == 0, 0.5).otherwise(F.col("similarity"))
    weight = F.col("contribution") * F.pow(F.lit(0.7), F.col("level")) * F.when(core, F.col("core_boost") * (0.95 + 0.1 * near)).otherwise(1.0)
    return each.select("query_id", "tag_id", weight.alias("weight"), core.alias("is_core"), "level")


def field_tags(seed: DataFrame, field: DataFrame, boosts: DataFrame, tags: DataFrame, cores: DataFrame, c: Config = Config()) -> DataFrame:
    """(query_id, tag_id, weight, is_core, level, source_type, hop): seeds at the larger of weight and energy, the strongest
    emergent nodes, and core tags that are in neither, by the largest weight."""
    joined = field.select("query_id", F.col("node").alias("tag_id"), "energy", "hop", "source_type").join(seed.select("query_id", "tag_id", "weight", "is_core", "level"), ["query_id", "tag_id"], "full_outer")
    known = F.col("weight").isNotNull()
    rows = joined.select("query_id", "tag_id", F.greatest("weight", "energy").alias("weight"), F.coalesce("is_core", F.lit(False)).alias("is_core"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("source_type", F.when(F.col("is_core"), "core").otherwise("seed")).alias("source_type"), F.coalesce("hop", F.lit(0)).alias("hop"), known.alias("is_seed"))
    rank = F.row_number().over(Window.partitionBy("query_id", "is_seed").orderBy(F.desc("weight"), "tag_id"))
    rows = rows.withColumn("rank", rank).filter(F.col("is_seed") | (F.col("rank") <= c.spread.max_emergent)).drop("rank", "is_seed")
    # A core tag is there when any tag of its name is, whatever the case.
    named = tags.select("tag_id", F.lower("name").alias("low"))
    there = rows.select("query_id", "tag_id").join(named, "tag_id").select("query_id", "low").distinct()
    missing = cores.select("query_id", F.lower("name").alias("low")).distinct().join(there, ["query_id", "low"], "left_anti")
    missing = missing.join(named, "low").groupBy("query_id", "low").agg(F.min("tag_id").alias("tag_id"))
    largest = rows.groupBy("query_id").agg(F.max("weight").alias("largest"))
    virtual = missing.join(largest, "query_id", "left").join(boosts.select("query_id", "core_boost"), "query_id")
    weight = F.coalesce(F.col("largest") / c.fusion.core_factor, F.lit(1.0)) * F.col("core_boost")
    return rows.unionByName(virtual.select("query_id", "tag_id", weight.alias("weight"), F.lit(True).alias("is_core"), F.lit(0).alias("level"), F.lit("core").alias("source_type"), F.lit(0).alias("hop")))


def context_vector(tags: DataFrame) -> DataFrame:
    """(query_id, context, total): the weighted mean of (query_id, weight, vector), of unit length."""
    flat = tags.filter("vector is not null").select("query_id", "weight", F.posexplode(F.col("vector").cast("array<double>")))
    sums = flat.groupBy("query_id", "pos").agg(F.sum(F.col("col") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("w")).alias("x")))), lambda p: p["x"])  # one element for each dimension
    return sums.filter("w > 0").groupBy("query_id").agg(vec.normalize(mean).alias("context"), F.max("w").alias("total"))


def fuse(queries: DataFrame, context: DataFrame, boosts: DataFrame) -> DataFrame:
    """(query_id, vector, fused, alpha): a query without context keeps its vector, fused false."""
    rows = queries.select("query_id", "vector").join(boosts.select("query_id", "boost"), "query_id", "left").join(context.select("query_id", "context"), "query_id", "left")
    alpha = F.least(F.lit(1.0), F.col("boost"))
    some = F.col("context").isNotNull() & alpha.isNotNull()
    return rows.select("query_id", F.when(some, vec.mix(F.col("vector"), F.col("context"), 1 - alpha, alpha)).otherwise(F.col("vector").cast("array<double>")).alias("vector"), some.alias("fused"), F.when(some, alpha).alias("alpha"))


def merged_tags(rows: DataFrame, tags: DataFrame, c: Config = Config()) -> DataFrame:
    """field_tags after the suppression of near-equal tags, with name and vector."""
    full = rows.join(tags.select("tag_id", "name", F.col("vector").cast("array<double>").alias("vector")), "tag_id", "left")
    return tag_dedup(full.select("query_id", "tag_id", "weight", "is_core", "level", "source_type", "hop", "name", "vector"), c.fusion.tag_dedup)


def matched_tags(rows: DataFrame, c: Config = Config()) -> DataFrame:
    """(query_id, rank, tag, weight, level, source_type, hop, notation): core tags always, others above a share of the
    largest weight, which is higher for technical names; the strongest few."""
    largest = F.max("weight").over(Window.partitionBy("query_id"))
    name = F.coalesce("name", F.lit(""))
    share = F.when(is_technical(name), c.fusion.technical).otherwise(c.fusion.normal)
    rows = rows.withColumn("largest", largest).filter(F.col("is_core") | (F.col("weight") > F.col("largest") * share))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "tag_id")).cast("long")
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= c.fusion.matched_tags)
    return rows.select("query_id", "rank", name.alias("tag"), "weight", "level", "source_type", "hop", notation(F.col("name"), F.col("tag_id").cast("string"), F.col("weight"), F.col("source_type"), F.col("hop").cast("string")).alias("notation"))


def level_tags(levels: DataFrame, tags: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, rank, tag, weight, level, source_type, hop, notation): tags of all pyramid levels by name at their largest
    contribution, and the first level that has it; without a graph."""
    each = levels.select("query_id", "level", F.inline("tags")).join(tags.select("tag_id", "name"), "tag_id")
    best = each.groupBy("query_id", F.col("name").alias("tag")).agg(F.max("contribution").alias("weight"), F.max_by("level", F.struct("contribution", -F.col("level"))).alias("level"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "tag")).cast("long")
    notation = F.concat(F.lit("="), "tag", F.lit(":"), F.format_string("%.2f", F.col("weight")), F.lit("@seed"))
    rows = best.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return rows.select("query_id", "rank", "tag", "weight", "level", F.lit("seed").alias("source_type"), F.lit(0).alias("hop"), notation.alias("notation"))
