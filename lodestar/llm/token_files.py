"""Token ids in flat binary files with 64-bit document offsets.

A part holds the documents of a range of doc_id in ascending order as four files in one folder:

* part-N-A.u2.bin: the ids of all its documents, end id included, as unsigned little-endian integers, 16 bits wide where
  the vocabulary allows it and 32 bits otherwise (.u4.bin); A is the attempt of the task that wrote it;
* part-N-A.offsets: unsigned 64-bit, one more than the documents: where each begins, in ids from the start of the part;
* part-N-A.docs and part-N-A.null: doc_id as signed 64-bit integers, and one byte that is 1 where doc_id is null.

The place of a document among all ids is its offset plus its part's base; bases are prefix sums of the parts' totals.
Files are never renamed: a part is the files of the one attempt whose row reached the driver, listed in parts.json, so a
task can run again, or twice at a time, on any store. There are as many parts as tasks that the session shuffles into, and
more where they would hold more than PART_BYTES of text. Readers map files of a mounted folder into memory; from other
stores they read the ranges that they need.

Edge cases: a null or empty text is its end id alone; documents of equal doc_id are ordered by text, a null doc_id
comes first; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import shared_path
from lodestar.llm.encoding import Encoder

END_ID, VOCABULARY = 2, 49_408
#: Text of a part, and documents that a reader takes at once.
PART_BYTES, STEP = 256 << 20, 4096
_FILES = (".offsets", ".docs", ".null")


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, vocabulary: int = VOCABULARY) -> list[tuple[int, int, int, int]]:
    """Write docs (doc_id, text) to folder, a URI; returns (part, attempt, documents, ids) of the parts that have documents."""
    spark = docs.sparkSession
    width = 2 if vocabulary <= 1 << 16 else 4
    store, top = pafs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    texts = texts.withColumn("tie", F.crc32("text")).withColumn("row", F.monotonically_increasing_id())
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    texts = texts.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, top = pafs.FileSystem.from_uri(folder)
        part, attempt = task.partitionId(), task.taskAttemptId()
        encoder, total, n, files = Encoder(path, "words"), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = [store.open_output_stream(f"{top}/part-{part:06d}-{attempt}{x}") for x in (f".u{width}.bin", *_FILES)]
                files[1].write(np.zeros(1, "<u8").tobytes())
            ends = np.zeros(batch.num_rows, "<u8")
            for i, encoded in enumerate(encoder.encode(t.as_py() for t in batch.column("text"))):
                ids = np.append(np.frombuffer(encoded, "<u4"), np.uint32(end_id))
                files[0].write(ids.astype(f"<u{width}").tobytes())
                total += len(ids)
                ends[i] = total
            n += batch.num_rows
            files[1].write(ends.tobytes())
            ids = batch.column("doc_id")
            files[2].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            files[3].write(ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
        if files is not None:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, attempt, n, total)], ["part", "attempt", "docs", "ids"])

    found = sorted(map(tuple, texts.mapInArrow(run, "part long, attempt long, docs long, ids long").collect()))  # a row for each part
    with store.open_output_stream(f"{top}/parts.json") as f:
        f.write(json.dumps({"width": width, "parts": found}).encode())
    return found


def _reader(store: pafs.FileSystem, path: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """A function from a range of elements to those of a file."""
    size = np.dtype(kind).itemsize
    if isinstance(store, pafs.LocalFileSystem):
        whole = np.memmap(path, dtype=kind, mode="r")
        return lambda a, b: whole[a:b]
    file = store.open_input_file(path)
    return lambda a, b: np.frombuffer(file.read_at((b - a) * size, a * size), kind)


def read_token_files(spark: SparkSession, folder: str, parts: list[tuple[int, int, int, int]], vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    width = 2 if vocabulary <= 1 << 16 else 4
    bases, base = [], 0
    for *_, ids in parts:
        bases.append(base)
        base += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for at in batch.column("at").to_pylist():
                part, attempt, n, _ = parts[at]
                tokens, offsets, docs, null = (_reader(store, f"{top}/part-{part:06d}-{attempt}{x}", k) for x, k in zip((f".u{width}.bin", *_FILES), (f"<u{width}", "<u8", "<i8", "u1"), strict=True))
                for lo in range(0, n, STEP):
                    hi = min(lo + STEP, n)
                    cuts = offsets(lo, hi + 1).astype(np.int64)
                    crc = [zlib.crc32(tokens(a, b).astype("<u4").tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs(lo, hi), pa.int64(), mask=null(lo, hi).astype(bool)), pa.array(cuts[:-1] + bases[at]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if not parts:
        return spark.range(0).selectExpr("id as doc_id", "id as start", "id as n_tokens", "id as ids_crc32")
    return spark.range(0, len(parts), 1, len(parts)).select(F.col("id").alias("at")).mapInArrow(run, schema)


def token_file_index(docs: DataFrame, path: str) -> DataFrame:
    """Write docs to the shared folder and read them back."""
    folder = shared_path(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, path, folder))
