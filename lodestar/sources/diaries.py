"""Diary files, chunk tables as JSON lines, and embedding services."""

from __future__ import annotations

import json
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text, vec
from lodestar.tables import written

CHUNK = "id long, file string, chunkIndex int, content string, vector array<float>"


def read_diaries(spark: SparkSession, root: str) -> DataFrame:
    """(file, raw, content_md5, mtime, agent, written_date, hhmm, body) of every .md file below root. A file that goes
    while they are read counts as gone."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreMissingFiles", True).text(root, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("mtime"))
    return parsed(rows)


def parsed(rows: DataFrame) -> DataFrame:
    """(file, raw, mtime, ...) with the parts of the diary form: `[date] - agent`, `[HH:MM]`, body, tag line."""
    head = "^\\[(\\d{4}-\\d{2}-\\d{2})\\] - ([^\\n]*)\\n\\[(\\d{2}:\\d{2})\\]\\n?"
    part = lambda i: F.nullif(F.regexp_extract("raw", head, i), F.lit(""))
    body = F.regexp_replace(F.regexp_replace("raw", head, ""), "(?:^|\\n)[ \\t]*Tag[ \\t]*[:：][^\\n]*\\s*$", "")
    return rows.withColumns({"content_md5": F.md5("raw"), "written_date": F.to_date(part(1)), "agent": part(2), "hhmm": part(3), "body": text.trim(body)})


def diary_text(date: F.Column, agent: F.Column, hhmm: F.Column, body: F.Column, tags: F.Column) -> F.Column:
    """The four parts of a diary; tags: array of raw tags, each cleaned, all joined."""
    return F.concat(F.lit("["), date, F.lit("] - "), agent, F.lit("\n["), hhmm, F.lit("]\n"), body, F.lit("\n\nTag: "), F.array_join(F.transform(tags, text.clean_tag), ", "))


def chunked(diaries: DataFrame, max_tokens: int = 6800, overlap: int = 680) -> DataFrame:
    """(file, chunk_index, content) of (file, raw)."""
    return diaries.select("file", F.posexplode(text.chunk_text(F.col("raw"), max_tokens, overlap)).alias("chunk_index", "content"))


def tag_occurrences(diaries: DataFrame) -> DataFrame:
    """(file, name, pos) of (file, raw): pos from 1."""
    return diaries.select("file", F.posexplode(text.parse_tags(F.col("raw"))).alias("p", "name")).select("file", "name", (F.col("p") + 1).alias("pos"))


def read_chunks(spark: SparkSession, path: str, dimension: int, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid chunks of unit length, one row with the counts of bad and orphan ones) of a JSON-lines index."""
    rows = spark.read.schema(CHUNK + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = written(rows, "json-chunks")  # a file read by its corrupt column alone can't be counted; parsed once
    good = F.col("_corrupt").isNull() & F.col("id").isNotNull() & F.col("content").isNotNull() & (F.size("vector") == dimension)
    valid = rows.filter(good).withColumn("vector", vec.normalize(F.col("vector"))).drop("_corrupt")
    orphans = valid.join(files.select("file"), "file", "left_anti") if files is not None else valid.limit(0)
    counts = rows.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("bad")).crossJoin(orphans.agg(F.count("*").alias("orphans")))  # one row each
    return (valid.join(files.select("file"), "file", "left_semi") if files is not None else valid), counts


def read_tags(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tags (tag_id, name, vector), occurrences (file, tag_id, pos)) of a JSON-lines tag index, in order of its lines.
    A line that can't be read raises when the tables are used, or is skipped where strict is false."""
    schema = "name string, vector array<float>, occurrences array<struct<file:string,pos:int>>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    rows = written(rows.withColumn("_line", F.monotonically_increasing_id()), "tag-lines")
    before = Window.orderBy("_part")  # a row for each partition of lines
    parts = rows.groupBy(F.shiftright("_line", 33).alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(before) - F.col("_n"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_line")) - 1
    ranked = rows.withColumn("_part", F.shiftright("_line", 33)).withColumn("_place", place).join(F.broadcast(parts), "_part")
    ranked = ranked.select((F.col("_before") + F.col("_place")).alias("tag_id"), "name", "vector", "occurrences")
    return ranked.drop("occurrences"), ranked.select(F.inline("occurrences"), "tag_id").select("file", "tag_id", "pos")


def write_diaries(rows: DataFrame, root: str) -> int:
    """Write (file, raw) as files, file relative to root or a URI below it; each is written under another name and moved
    into place, so that readers see all of it or nothing. Returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for file, raw in zip(batch.column("file").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                path = pafs.FileSystem.from_uri(file)[1] if "://" in file or file.startswith("file:") else f"{top}/{file}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(raw.encode())
                store.move(part, path)
            yield pa.RecordBatch.from_arrays([batch.column("file")], ["file"])

    return rows.select("file", "raw").mapInArrow(run, "file string").count()


def http_embedder(url: str, model: str, dimension: int, batch: int = 16, timeout: float = 60, waits: tuple[float, ...] = (1, 3), key: str | None = None) -> Callable[[list[str]], list[list[float] | None]]:
    """A function from texts to vectors, null where the service fails or answers with another size."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = [None] * len(texts)
        for lo in range(0, len(texts), batch):
            body = json.dumps({"model": model, "input": texts[lo : lo + batch]}).encode()
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
            for wait in (*waits, None):
                try:
                    with urllib.request.urlopen(urllib.request.Request(f"{url}/embeddings", body, headers), timeout=timeout) as answer:
                        for item in json.load(answer)["data"]:
                            if len(item["embedding"]) == dimension:
                                out[lo + item["index"]] = item["embedding"]
                    break
                except (OSError, ValueError, KeyError, IndexError, TypeError):
                    if wait is not None:
                        time.sleep(wait)
        return out

    return embed


def embedded(rows: DataFrame, column: str, embed: Callable[[list[str]], list[list[float] | None]], concurrency: int = 2) -> DataFrame:
    """rows with a vector for each text of column; `concurrency` tasks call the service at a time. They are written, so the
    service is asked once for each text, and what follows is not bound to that number of tasks."""

    @F.pandas_udf("array<float>")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in values:
            yield pd.Series(embed(s.fillna("").tolist()), index=s.index, dtype=object)

    return written(rows.repartition(concurrency).withColumn("vector", run(F.col(column))), "embedded")
