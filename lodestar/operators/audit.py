"""Consistency audit, usage and fingerprints of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_usage(occurrences: DataFrame, tags: DataFrame) -> DataFrame:
    """(name, occurrences, files, vectorized) of every tag, used or not."""
    used = occurrences.groupBy("tag_id").agg(F.count("*").alias("occurrences"), F.countDistinct("file").alias("files"))
    rows = tags.select("tag_id", "name", F.col("vector").isNotNull().alias("vectorized")).join(used, "tag_id", "left")
    return rows.select("name", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("files", F.lit(0)).alias("files"), "vectorized")


def orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(file) of chunks whose file is gone."""
    return chunks.select("file").distinct().join(files.select("file"), "file", "left_anti")


def unindexed(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file) of files without a chunk."""
    return files.select("file").join(chunks.select("file").distinct(), "file", "left_anti")


def tag_fingerprint(tags: DataFrame, sig: str) -> DataFrame:
    """One row (fingerprint): md5 of the signature and of the sorted names' own md5s, summed by part so that no task
    holds all names."""
    digest = F.md5("name")
    halves = [F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(4)]
    return tags.agg(F.count("*").alias("n"), *halves).select(F.md5(F.concat_ws(":", F.lit(sig), F.col("n").cast("string"), *(F.coalesce(F.col(f"h{i}").cast("string"), F.lit("0")) for i in range(4)))).alias("fingerprint"))


def store_stats(files: DataFrame, chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """One row (diaries, chunks, tags, vectorized_tags)."""
    return files.agg(F.count("*").alias("diaries")).crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(tags.agg(F.count("*").alias("tags"), F.count_if(F.col("vector").isNotNull()).alias("vectorized_tags")))  # one row each


def doctor(files: DataFrame, chunks: DataFrame, tags: DataFrame, sig: str, known_sig: str, fingerprint: str | None) -> DataFrame:
    """(check, ok, n): the signature, orphan chunks, files that are not indexed, tags without vector, stale axes."""
    spark = files.sparkSession
    row = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("ok"), "n")
    wrong = spark.range(1).filter(F.lit(sig != known_sig))
    stale = tag_fingerprint(tags, sig).filter(~F.col("fingerprint").eqNullSafe(F.lit(fingerprint)))
    out = row("signature", wrong)
    for name, df in (("orphan_chunks", orphans(chunks, files)), ("unindexed_files", unindexed(files, chunks)), ("vectorless_tags", tags.filter("vector is null")), ("stale_axes", stale)):
        out = out.unionByName(row(name, df))
    return out
