"""Context injection: which turns get remembered context, from which text, and how it is cut to a budget."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.config import Config, Injection
from lodestar.functions import vec
from lodestar.plans.recall import recall
from lodestar.tables import written

T = TypeVar("T")

# The wrapping of remembered context.
HEAD, FOOT = "<memory>\nRemembered from earlier conversations, for reference:\n\n", "</memory>"

#: The least length of a block's first line, with the line breaks around it and after the text.
LEAST_COST = len("\n[1] (score NaN · )\n") + 1


def eligible(turns: DataFrame) -> DataFrame:
    """User turns (conv_id, turn, role, text) whose text is not empty, and the last assistant text before each. Where turns
    have a source_kind, only what users themselves sent counts: injected context and tools' answers don't."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(order)
    rows = turns.withColumn("assistant_text", before).filter((F.col("role") == "user") & (F.col("text") != ""))
    if "source_kind" in turns.columns:
        rows = rows.filter(F.col("source_kind") == "user")
    return rows.select("conv_id", "turn", F.col("text").alias("user_text"), "assistant_text")


def throttled(turns: DataFrame) -> DataFrame:
    """eligible turns with seed_key and skip: true where the conversation's turn before had the same key."""
    key = F.concat(F.col("user_text"), F.lit("\n"), F.coalesce("assistant_text", F.lit("")))
    rows = turns.withColumn("seed_key", key)
    last = F.lag("seed_key").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("skip", F.coalesce(F.col("seed_key") == last, F.lit(False)))


def combined(rows: DataFrame, c: Injection = Injection()) -> DataFrame:
    """rows (user_vector, assistant_vector, ...) with their mixed vector."""
    return rows.withColumn("vector", vec.mix(F.col("user_vector"), F.col("assistant_vector"), c.user_weight, c.assistant_weight))


def packed(blocks: DataFrame, max_chars: int = Injection.max_chars) -> DataFrame:
    """(query_id, used, text): blocks (query_id, file, score, text, ord) by score until the first that doesn't fit; the
    best one is cut rather than left out. A budget that the wrapping exceeds gives the wrapping alone."""
    room = max(1, max_chars) - len(HEAD) - len(FOOT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    rows = blocks.filter("text is not null and score is not null")
    # More than `most` blocks don't fit whatever they say, and of a text more than `room` characters are never shown: each
    # task hands on that much of a query, and no whole texts are sorted.
    most = max(1, room // LEAST_COST)
    rows = rows.select("query_id", "file", "score", "ord", F.length("text").alias("length"), F.substring("text", 1, max(1, room)).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    head = F.concat(F.lit("\n["), F.col("n").cast("string"), F.lit("] (score "), F.format_string("%.2f", F.col("score")), F.lit(" · "), F.coalesce("file", F.lit("")), F.lit(")\n"))
    rows = rows.withColumn("head", head).withColumn("cost", F.length("head") + 1 + F.col("length"))
    # All costs are positive, so once the running sum is above the room it stays there.
    rows = rows.withColumn("total", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    free = F.lit(room) - F.length("head") - 1
    cut = (F.col("n") == 1) & (F.col("total") > room) & (free > 0)
    rows = rows.withColumn("body", F.when(F.col("total") <= room, F.col("text")).when(cut, F.substring(F.col("text"), F.lit(1), free)))
    parts = F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("n", F.concat("head", "body", F.lit("\n")).alias("part")))))
    out = rows.groupBy("query_id").agg(parts.alias("parts"))  # as many as fit the budget
    return out.select("query_id", F.size("parts").cast("long").alias("used"), F.concat(F.lit(HEAD), F.array_join(F.transform("parts", lambda p: p["part"]), ""), F.lit(FOOT)).alias("text"))


def injected(turns: DataFrame, embedded, index, c: Config = Config()) -> DataFrame:
    """(conv_id, turn, used, text): remembered context for the eligible turns that are not throttled.

    embedded: a function of a DataFrame and a text column that adds `vector`. Structural supplements, which lie below the
    floor, are left out again. A turn whose text has no vector, or that nothing resembles, gets none.
    """
    c = replace(c, injection=c.injection.clamped())
    seeds = throttled(eligible(turns)).filter("not skip").withColumn("query_id", F.xxhash64("conv_id", "turn"))
    users = embedded(seeds.select("query_id", "user_text"), "user_text").select("query_id", F.col("vector").alias("user_vector"))
    others = embedded(seeds.filter("assistant_text is not null").select("query_id", "assistant_text"), "assistant_text").select("query_id", F.col("vector").alias("assistant_vector"))
    rows = combined(users.join(others, "query_id", "left"), c.injection).filter("vector is not null").select("query_id", "vector")
    rows = written(rows, "seeds")
    options = replace(c, recall=replace(c.recall, k=c.injection.k, floor=c.injection.floor))
    blocks = recall(rows, rows.select("query_id", F.lit(None).cast("string").alias("name")).limit(0), index, options)[0]
    blocks = blocks.filter(F.col("score") >= c.injection.floor).withColumn("ord", F.col("chunk_id"))
    return seeds.select("conv_id", "turn", "query_id").join(packed(blocks, c.injection.max_chars), "query_id").drop("query_id")


def within(spark: SparkSession, seconds: float, run: Callable[[], T]) -> T | None:
    """What run gives, or None where it takes longer: its jobs are cancelled, and the turn goes on without context."""
    group, out = f"within-{uuid.uuid4().hex}", []

    def job() -> None:
        spark.sparkContext.setJobGroup(group, "bounded recall", interruptOnCancel=True)
        try:
            out.append((run(), None))
        except Exception as e:  # handed to the caller, unless the time was up first
            out.append((None, e))

    thread = InheritableThread(target=job, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        spark.sparkContext.cancelJobGroup(group)
        return None
    value, error = out[0]
    if error is not None:
        raise error
    return value
