"""Streams: changed files by content, and the injection throttle as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.plans import build
from lodestar.tables import written


def newest(events: DataFrame) -> DataFrame:
    """The last event (file, raw, mtime, ...) of each file of a micro-batch: what debouncing by file leaves. Of several with
    one mtime that of the larger digest, so a batch that runs again takes the same."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("mtime"), F.desc(F.md5("raw")), F.desc("raw")))
    return events.withColumn("r", rank).filter(F.col("r") == 1).drop("r")


def index_stream(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a stream of file events (file, raw, mtime) whose micro-batches reach `apply` once for each file.

    `apply` replaces the rows of its files by key, so a batch that runs again changes nothing.
    """
    return events.writeStream.foreachBatch(lambda batch, i: apply(newest(batch), i)).option("checkpointLocation", checkpoint).start()


def applier(spark: SparkSession, home: str, embed: Callable, sig: str, **options) -> Callable[[DataFrame, int], None]:
    """An `apply` that replaces the files of a batch (file, raw, mtime) in the index at home; a null raw is a deleted file."""

    def apply(batch: DataFrame, _: int) -> None:
        batch = written(batch, "batch")
        if not batch.isEmpty():
            build.apply_changes(spark, home, batch.filter("raw is not null"), batch.filter("raw is null"), embed, sig, **options)

    return apply


def watch(spark: SparkSession, root: str, home: str, embed: Callable, sig: str, checkpoint: str, seconds: float = 2.0, settled: float = 0.5, **options):
    """Start a stream that holds the diaries below root against the index every few seconds: files that are new, changed or
    gone are taken over once they have been quiet for `settled` seconds. The manifest says what changed, so a tick that runs
    again, or after a stop, changes nothing twice."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(lambda batch, i: build.refresh(spark, root, home, embed, sig, settled, **options) and None)
    return writer.trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()


def throttle_stream(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, seed_key, skip) of streamed turns (conv_id, turn, seed_key): skip where the conversation's last key
    was the same. The state of a conversation is its last key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("turn")
        skip = []
        for k in rows["seed_key"]:
            skip.append(k == last)
            last = k
        state.update((last,))
        yield rows.assign(conv_id=key[0], skip=skip)[["conv_id", "turn", "seed_key", "skip"]]

    return turns.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, turn long, seed_key string, skip boolean", "last string", "append", GroupStateTimeout.NoTimeout)
