"""Generations of derived tables, manifests, and changes of diaries.

The source files are the truth; chunks, tags and graph are tables of one generation each: written whole to a new path, with
a mark written last. The current generation is the highest one with a mark that was written to its end, so there is always
one, whatever was cut short. Readers keep the generation they began with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.sources import diaries
from lodestar.tables import written


class SignatureMismatch(RuntimeError):
    """The index was made by another model or dimension; only a rebuild replaces it."""


def manifest(files: DataFrame) -> DataFrame:
    """(file, content_md5) of (file, raw)."""
    return files.select("file", F.md5("raw").alias("content_md5"))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(file, change) between two manifests: added, changed or deleted."""
    joined = now.select("file", F.col("content_md5").alias("a")).join(before.select("file", F.col("content_md5").alias("b")), "file", "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return joined.select("file", change.alias("change")).filter("change is not null")


def upserted(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """old without the rows of touched files, and the new rows."""
    return old.join(touched.select("file").distinct(), "file", "left_anti").unionByName(new)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def current(spark: SparkSession, store: str) -> tuple[int, str] | None:
    """(generation, signature) of the highest generation that is whole, or None."""
    fs, p, _ = _hadoop(spark, f"{store}/gen=*/mark/_SUCCESS")
    found = fs.globStatus(p) or []
    numbers = [int(x.getPath().getParent().getParent().getName().removeprefix("gen=")) for x in found]
    if not numbers:
        return None
    row = spark.read.schema("generation long, sig string").json(f"{store}/gen={max(numbers)}/mark").first()
    return row["generation"], row["sig"]


def publish(spark: SparkSession, store: str, tables: dict[str, DataFrame], sig: str, rebuild: bool = False) -> int:
    """Write tables as the next generation and mark it; the generation before stays for its readers."""
    known = current(spark, store)
    if known and known[1] != sig and not rebuild:
        raise SignatureMismatch(f"the index is of {known[1]}, not of {sig}")
    generation = known[0] + 1 if known else 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{store}/gen={generation}/{name}")
    mark = spark.range(1).select(F.lit(generation).cast("long").alias("generation"), F.lit(sig).alias("sig"))
    mark.coalesce(1).write.mode("overwrite").json(f"{store}/gen={generation}/mark")
    return generation


def holds(spark: SparkSession, store: str, name: str) -> bool:
    """Whether the current generation has a table of this name."""
    known = current(spark, store)
    fs, p, _ = _hadoop(spark, f"{store}/gen={known[0] if known else 0}/{name}/_SUCCESS")
    return fs.exists(p)


def load(spark: SparkSession, store: str, name: str, sig: str) -> DataFrame:
    known = current(spark, store)
    if known is None:
        raise FileNotFoundError(f"{store} has no generation")
    if known[1] != sig:
        raise SignatureMismatch(f"the index is of {known[1]}, not of {sig}")
    return spark.read.parquet(f"{store}/gen={known[0]}/{name}")


def file_stem(agent: Column, ts: Column, title: Column) -> Column:
    return F.concat(F.coalesce(agent, F.lit("")), F.lit("/"), F.date_format(ts, "yyyy-MM-dd-HH_mm_ss"), F.lit("-"), text.sanitize_title(F.coalesce(title, F.lit(""))))


def file_names(notes: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """notes (agent, ts, title, ...) with file: agent/date-time-title.md, and a suffix where several share a name. taken:
    (stem, last), the largest suffix that is in use for a stem, 0 for a file without one."""
    rows = notes.withColumn("stem", file_stem(F.col("agent"), F.col("ts"), F.col("title")))
    n = F.row_number().over(Window.partitionBy("stem").orderBy("ts", "title", "content")) - 1
    rows = rows.withColumn("n", n)
    if taken is not None:
        rows = rows.join(taken, "stem", "left").withColumn("n", F.col("n") + F.coalesce(F.col("last") + 1, F.lit(0))).drop("last")
    return rows.withColumn("file", F.concat("stem", F.when(F.col("n") > 0, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(".md"))).drop("stem", "n")


#: Requests up to which a target is looked for by a nested loop over their broadcast.
REQUESTS = 10_000


def updates(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, file, updated, error) of requests (request_id, target, replacement) over files (file, raw, mtime).

    The newest file that holds the target is changed where the target stands in it exactly once. REQUESTS requests are
    held against each file in its task; of more, a file's text is first cut into windows of a target's least length, and only
    the requests that begin with one of them are tried.
    """
    least = 15
    short = F.length("target") < least
    asked = requests.filter(~short)
    if asked.count() <= REQUESTS:
        hits = F.broadcast(asked).join(files, F.contains("raw", "target"))
    else:
        begins = F.transform(F.sequence(F.lit(1), F.greatest(F.length("raw") - least + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(F.col("raw"), i, F.lit(least))))
        places = files.select("file", F.explode(F.array_distinct(begins)).alias("begin"))
        tried = places.join(asked.select("request_id", F.xxhash64(F.substring("target", 1, least)).alias("begin")), "begin").select("file", "request_id").distinct()
        hits = tried.join(asked, "request_id").join(files, "file").filter(F.contains("raw", "target"))
    newest = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("mtime"), "file"))
    best = hits.withColumn("r", newest).filter(F.col("r") == 1).withColumn("n", text.occurrences(F.col("raw"), F.col("target")))
    out = best.select("request_id", F.when(F.col("n") == 1, F.col("file")).alias("file"), F.when(F.col("n") == 1, F.replace("raw", "target", "replacement")).alias("updated"), F.when(F.col("n") > 1, "ambiguous").alias("problem"))
    return requests.join(out, "request_id", "left").select("request_id", "file", "updated", F.when(short, "too short").otherwise(F.coalesce("problem", F.when(F.col("file").isNull(), "not found"))).alias("error"))


def saved(spark: SparkSession, root: str, notes: DataFrame, max_tokens: int = 6800, overlap: int = 680) -> DataFrame:
    """Write notes (agent, ts, title, content, tags) as diary files below root: (agent, ts, title, file, chunks, error).

    A note without content, or without a tag that is left when its tags are cleaned, has an error and no file. Notes of one
    agent, second and title, and files of that name that are there, get suffixes in order.
    """
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), text.clean_tag), lambda t: t != "")
    rows = notes.select("agent", "ts", "title", "content", tags.alias("tags"))
    rows = rows.withColumn("error", F.when(F.col("content").isNull(), "no content").when(F.size("tags") == 0, "no tags"))
    there = diaries.read_diaries(spark, root).select(F.regexp_extract("file", "([^/]+/[^/]+)\\.md$", 1).alias("stem"))
    number = F.nullif(F.regexp_extract("stem", "-(\\d+)$", 1), F.lit("")).cast("long")
    taken = there.select("stem", F.lit(0).cast("long").alias("n")).unionByName(there.filter(number.isNotNull()).select(F.regexp_replace("stem", "-\\d+$", "").alias("stem"), number.alias("n")))
    named = file_names(rows.filter("error is null"), taken.groupBy("stem").agg(F.max("n").alias("last")))
    body = F.when(F.endswith("content", F.lit("\n")), F.col("content")).otherwise(F.concat("content", F.lit("\n")))
    raw = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd"), F.lit("] - "), F.coalesce("agent", F.lit("")), F.lit("\n["), F.date_format("ts", "HH:mm"), F.lit("]\n"), body, F.lit("\nTag: "), F.array_join("tags", ", "), F.lit("\n"))
    rows_out = written(named.select("agent", "ts", "title", "file", raw.alias("raw"), F.size(text.chunk_text(F.col("content"), max_tokens, overlap)).alias("chunks")), "notes")
    diaries.write_diaries(rows_out.select("file", "raw"), root)
    return rows_out.select("agent", "ts", "title", "file", "chunks", F.lit(None).cast("string").alias("error")).unionByName(rows.filter("error is not null").select("agent", "ts", "title", F.lit(None).cast("string").alias("file"), F.lit(0).alias("chunks"), "error"))


def updated(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """Apply requests to the diary files below root: (request_id, file, error). Of several that change one file the one of
    the smallest id is written, the others get the error busy: they were found in the text before it."""
    found = written(updates(diaries.read_diaries(spark, root), requests), "updates")
    first = F.row_number().over(Window.partitionBy("file").orderBy("request_id"))
    found = written(found.withColumn("error", F.when(F.col("file").isNotNull() & (first > 1), "busy").otherwise(F.col("error"))), "updates")
    diaries.write_diaries(found.filter("file is not null and error is null").select("file", F.col("updated").alias("raw")), root)
    return found.select("request_id", F.when(F.col("error").isNull(), F.col("file")).alias("file"), "error")
