"""Build and refresh an index: diaries to chunks, tags, graph and axes, published as one generation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.functions import vec
from lodestar.operators import audit, axes, graph
from lodestar.plans.recall import Index
from lodestar.sources import diaries, store
from lodestar.tables import written

Embed = Callable[[list[str]], list[list[float] | None]]


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a dense id in this order: ranks within range partitions, and the partitions' sizes before them."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_rank", rank).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_part", "_before", "_rank")


def basis_table(spark: SparkSession, basis: axes.Basis) -> DataFrame:
    """(axis, vector, energy, label); axis -1 is the mean."""
    rows = [(-1, basis.mean.tolist(), 0.0, None)] + [(i, a.tolist(), float(e), n) for i, (a, e, n) in enumerate(zip(basis.axes, basis.energies, [*basis.labels, *[None] * len(basis.axes)], strict=False))]
    return spark.createDataFrame(rows, "axis int, vector array<double>, energy double, label string")


def basis_of(table: DataFrame) -> axes.Basis:
    """The basis of a table made by basis_table; it has at most max_basis rows."""
    rows = sorted(table.collect(), key=lambda r: r["axis"])
    return axes.Basis(np.array(rows[0]["vector"]), np.array([r["vector"] for r in rows[1:]]), np.array([r["energy"] for r in rows[1:]]), [r["label"] for r in rows[1:]])


def graph_fingerprint(tags: DataFrame, occurrences: DataFrame) -> str:
    """A digest of names, vectors and occurrences that does not depend on their order: sums of row hashes."""
    total = lambda df, *c: df.agg(F.count("*"), F.sum(F.xxhash64(*c).cast("decimal(38,0)"))).first()
    return ":".join(str(x) for x in (*total(tags, "name", "vector"), *total(occurrences, "file", "tag_id", "pos")))


def _derived(spark: SparkSession, chunks: DataFrame, tags: DataFrame, occurrences: DataFrame, manifest: DataFrame, sig: str, c: Config, before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All tables of a generation. Where names, vectors and occurrences are those of the generation before, its graph and
    axes are taken over."""
    print_ = graph_fingerprint(tags, occurrences)
    state = spark.createDataFrame([(print_, audit.tag_fingerprint(tags, sig).first()["fingerprint"])], "graph string, axes string")
    tables = {"chunks": chunks, "tags": tags, "occurrences": occurrences, "manifest": manifest, "state": state}
    if before and before["state"].first()["graph"] == print_:
        return tables | {k: before[k] for k in ("kernel", "axes") if k in before}
    usable = tags.filter("vector is not null")
    counted = graph.occurrences(occurrences)
    fact = graph.fact_matrix(counted.join(usable.select("tag_id"), "tag_id", "left_semi"), usable, c.cooccurrence)
    if usable.limit(2).count() < 2:  # too few tags for a graph: an empty one of the same form
        fact = fact.limit(0)
    tables["kernel"] = graph.kernel(fact, k=c.kernel)
    basis = axes.train(usable, c.axes)
    if basis is not None:
        tables["axes"] = basis_table(spark, basis)
    return tables


def _chunks(files: DataFrame, embed: Embed, max_tokens: int, overlap: int, first: int) -> DataFrame:
    """(file, chunk_index, content, vector, chunk_id) of files (file, raw), ids from first on."""
    found = diaries.embedded(diaries.chunked(files, max_tokens, overlap), "content", embed)
    found = numbered(found.withColumn("vector", vec.normalize(F.col("vector"))), ["file", "chunk_index"], "chunk_id")
    return found.withColumn("chunk_id", F.col("chunk_id") + first)


def _tags(names: DataFrame, embed: Embed, first: int) -> DataFrame:
    """(name, tag_id, vector) of distinct names, ids from first on."""
    return diaries.embedded(numbered(names, ["name"], "tag_id").withColumn("tag_id", F.col("tag_id") + first), "name", embed)


def build(spark: SparkSession, files: DataFrame, embed: Embed, sig: str = "", max_tokens: int = 6800, overlap: int = 680, c: Config = Config()) -> dict[str, DataFrame]:
    """Tables of an index of files (file, raw). Chunks and tags whose text the service can't embed keep a null vector; chunk
    vectors have unit length, tag vectors stay as they are."""
    chunks = written(_chunks(files, embed, max_tokens, overlap, 0), "chunks")
    named = written(diaries.tag_occurrences(files), "named")
    tags = _tags(named.select("name").distinct(), embed, 0)
    occurrences = written(named.join(tags.select("name", "tag_id"), "name").select("file", "tag_id", "pos"), "occurrences")
    return _derived(spark, chunks, tags, occurrences, store.manifest(files), sig, c)


def rebuild(spark: SparkSession, root: str, home: str, embed: Embed, sig: str, **options) -> int:
    """Read all diaries below root and publish a whole new generation in home, whatever it held before."""
    tables = build(spark, diaries.read_diaries(spark, root).select("file", "raw"), embed, sig, **options)
    return store.publish(spark, home, tables, sig, rebuild=True)


def _tables(spark: SparkSession, home: str, sig: str) -> dict[str, DataFrame]:
    """The tables of the current generation; axes only where they were trained."""
    out = {name: store.load(spark, home, name, sig) for name in ("chunks", "tags", "occurrences", "manifest", "state", "kernel")}
    if store.holds(spark, home, "axes"):
        out["axes"] = store.load(spark, home, "axes", sig)
    return out


def apply_changes(spark: SparkSession, home: str, changed: DataFrame, deleted: DataFrame, embed: Embed, sig: str, max_tokens: int = 6800, overlap: int = 680, c: Config = Config()) -> int:
    """Publish a generation in which the rows of changed files (file, raw) are replaced and those of deleted ones (file) gone.

    Only changed files are cut and embedded, and of tags only names that are new. Tags are never renumbered or dropped:
    new ones get the next ids, so vectors and edges of the others stay. Applying the same changes again changes nothing.
    """
    before = _tables(spark, home, sig)
    changed = written(changed.select("file", "raw"), "changed")
    touched = changed.select("file").unionByName(deleted.select("file")).distinct()
    first = lambda name, column: before[name].agg(F.coalesce(F.max(column) + 1, F.lit(0))).first()[0]
    chunks = store.upserted(before["chunks"], _chunks(changed, embed, max_tokens, overlap, first("chunks", "chunk_id")), touched)
    named = written(diaries.tag_occurrences(changed), "named")
    fresh = named.select("name").distinct().join(before["tags"], "name", "left_anti")
    tags = written(before["tags"].unionByName(_tags(fresh, embed, first("tags", "tag_id"))), "tags")
    mine = named.join(tags.select("name", "tag_id"), "name").select("file", "tag_id", "pos")
    occurrences = written(store.upserted(before["occurrences"], mine, touched), "occurrences")
    manifest = store.upserted(before["manifest"], store.manifest(changed), touched)
    return store.publish(spark, home, _derived(spark, written(chunks, "chunks"), tags, occurrences, manifest, sig, c, before), sig)


def refresh(spark: SparkSession, root: str, home: str, embed: Embed, sig: str, settled: float = 0.0, **options) -> int:
    """Publish a new generation where files were added, changed or deleted since the last; else return its number. Files
    that were written within the last `settled` seconds wait for the next call."""
    known = store.current(spark, home)
    if known is None:
        return rebuild(spark, root, home, embed, sig, **options)
    files = diaries.read_diaries(spark, root)
    quiet = F.col("mtime") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(settled).cast("decimal(18,6)"))
    changes = written(store.changes(store.manifest(files), store.load(spark, home, "manifest", sig)), "changes")
    changed = files.join(changes.filter("change <> 'deleted'"), "file", "left_semi").filter(quiet if settled else F.lit(True))
    changed, deleted = written(changed.select("file", "raw"), "changed"), changes.filter("change = 'deleted'")
    if changed.isEmpty() and deleted.isEmpty():
        return known[0]
    return apply_changes(spark, home, changed, deleted, embed, sig, **options)


def opened(spark: SparkSession, home: str, sig: str) -> Index:
    """The current generation as an index for recall."""
    t = _tables(spark, home, sig)
    basis = basis_of(t["axes"]) if "axes" in t else None  # else too few tags to train axes
    return Index(t["chunks"], t["tags"], t["occurrences"].select("file", "tag_id"), t["kernel"], basis)


def health(spark: SparkSession, root: str, home: str, sig: str) -> DataFrame:
    """The audit of the current generation against the files below root. Axes are stale where they were trained from other
    tags than the index has now."""
    known = store.current(spark, home)
    get = lambda name: store.load(spark, home, name, known[1])
    return audit.doctor(diaries.read_diaries(spark, root).select("file"), get("chunks"), get("tags"), sig, known[1], get("state").first()["axes"])
