"""Identity and near-duplicate suppression of recall candidates."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import Recall
from lodestar.functions.text import normalize_path, normalize_text
from lodestar.operators.similarity import ALONE

# How far each source is preferred.
PRIORITY = {"rag": 50, "time": 45, "bm25_tag": 40, "bm25_body": 40, "continuity": 35, "associate": 10, "unknown": 0}


def source_priority(source: Column) -> Column:
    """A missing source counts as rag; any other that begins with bm25 as bm25; the rest as unknown."""
    out = F.when(source.isNull(), PRIORITY["rag"])
    for name, value in PRIORITY.items():
        out = out.when(source == name, value)
    return out.when(source.startswith("bm25"), PRIORITY["bm25_tag"]).otherwise(PRIORITY["unknown"])


def effective_score(rerank: Column, rrf: Column, score: Column, original: Column) -> Column:
    return F.coalesce(rerank, rrf, score, original, F.lit(0.0))


def hard_dedup_ranked(candidates: DataFrame, norm: str = "norm_text") -> DataFrame:
    """Candidates (query_id, ord, score, <norm>) without id and with places of their own: the first of the best score of
    each normalised text stays. This equals the sequential pass below on such rows, without one."""
    rank = F.row_number().over(Window.partitionBy("query_id", norm).orderBy(F.desc("score"), "ord"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") == 1).drop("rank")


def identities(file: Column, chunk_index: Column, text: Column, chunk_id: Column | None = None) -> Column:
    """Names under which a candidate is known: id, normalised text, and lower-case path with chunk."""
    norm, path = normalize_text(text), normalize_path(file)
    parts = [F.when(norm != "", F.concat(F.lit("text:"), norm)), F.when(path != "", F.concat(F.lit("path-chunk:"), path, F.lit(":"), chunk_index))]
    if chunk_id is not None:
        parts.insert(0, F.when(chunk_id.isNotNull(), F.concat(F.lit("chunk:"), chunk_id)))
    return F.array_compact(F.array(*parts))


def hard_dedup(candidates: DataFrame) -> DataFrame:
    """(query_id, ord) that stay, of candidates (query_id, ord, names, priority, score, completeness).

    In order of ord a row joins the first slot that knows one of its names, and takes it over when it is better by
    priority, then score, then completeness. From then on the slot owns the names of the row that stood for it and of the
    row that joined, also those that another slot had. A row that knows the names of two slots joins the first only; the
    other stays. That is order-dependent and so sequential within a query, whose candidates are few.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        slots: list[list] = []
        known: dict[str, int] = {}
        for r in rows.sort_values("ord").itertuples():
            rank = (r.priority, r.score, r.completeness)
            at = next((known[n] for n in r.names if n in known), None)
            owned = list(r.names)
            if at is None:
                at = len(slots)
                slots.append([rank, r.ord, owned])
            else:
                owned = [*slots[at][2], *owned]
                if rank > slots[at][0]:
                    slots[at] = [rank, r.ord, list(r.names)]
            for n in owned:
                known[n] = at
        return pd.DataFrame({"query_id": rows["query_id"].iloc[:1].repeat(len(slots)).to_numpy(), "ord": [o for _, o, _ in slots]})

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, ord long")


def _unit(x: np.ndarray | None) -> np.ndarray | None:
    if x is None or not (n := float(np.linalg.norm(x))) or not np.isfinite(n):
        return None
    return np.asarray(x, float) / n


def unlike(units: list[np.ndarray | None], order: list[int], threshold: float, limit: int, before: list[np.ndarray | None] = ()) -> list[int]:
    """The places, in this order, of the unit vectors that have no cosine of threshold or more to one kept before, nor to the
    vectors kept earlier; what has no vector stays. At most `limit`, with those kept earlier."""
    kept: list[int] = []
    known: dict[int, tuple[np.ndarray, int]] = {}  # by dimension: unit vectors kept so far, in a matrix that doubles

    def add(u: np.ndarray) -> None:
        matrix, n = known.get(len(u), (np.empty((16, len(u))), 0))
        if n == len(matrix):
            matrix = np.concatenate([matrix, np.empty_like(matrix)])
        matrix[n] = u
        known[len(u)] = matrix, n + 1

    for u in before:
        if u is not None:
            add(u)
    for i in order:
        if len(before) + len(kept) >= limit:
            break
        u = units[i]
        if u is not None:
            matrix, n = known.get(len(u), (None, 0))
            if n and float((matrix[:n] @ u).max()) >= threshold:
                continue
            add(u)
        kept.append(i)
    return kept


def settled(candidates: DataFrame, before: DataFrame | None, threshold: float, limit: int) -> DataFrame:
    """(query_id, item_id, score, near, vector, twin, kept) after candidates of the same columns but the last, which come
    behind those that `before`, the rows of an earlier call, was made from: all kept ones, and, with a null vector, those
    that went and whose text others have too. Equal texts are one first, that of the best score."""
    columns = ["query_id", "item_id", "score", "near", "vector", "twin", "kept"]
    rows = candidates.select(*columns[:-1], F.lit(None).cast("boolean").alias("kept"))
    if before is not None:
        rows = rows.unionByName(before)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        old = rows["kept"].notna().to_numpy()
        known = set(rows["twin"][old])
        score, near, item, twin = (rows[c].tolist() for c in ("score", "near", "item_id", "twin"))
        order, texts = [], set()
        for i in sorted(np.flatnonzero(~old).tolist(), key=lambda i: (-score[i], item[i])):
            if twin[i] == ALONE or (twin[i] not in known and twin[i] not in texts):
                order.append(i)
                texts.add(twin[i])
        order.sort(key=lambda i: (-near[i], -score[i], item[i]))
        vectors = rows["vector"].tolist()
        units: list = [None] * len(rows)
        for i in order:
            units[i] = _unit(vectors[i])
        earlier = [_unit(vectors[i]) for i in np.flatnonzero(old & (rows["kept"] == True).to_numpy())]  # noqa: E712
        kept = unlike(units, order, threshold, limit, earlier)
        gone = [i for i in order if twin[i] != ALONE and i not in set(kept)]
        out = rows.iloc[[*np.flatnonzero(old), *kept, *gone]].copy()
        out["kept"] = [*rows["kept"][old], *[True] * len(kept), *[False] * len(gone)]
        out["vector"] = [v if k else None for v, k in zip(out["vector"], out["kept"], strict=True)]
        return out[columns]

    return rows.groupBy("query_id").applyInPandas(run, rows.select(columns).schema)


def semantic_dedup(candidates: DataFrame, queries: DataFrame, threshold: float = Recall.dedup, limit: int = Recall.max_results) -> DataFrame:
    """The candidates (query_id, ord, score, priority, vector, ...) that resemble no better one of their query.

    Best is nearest to the query vector, then of the higher score and priority, then first. A candidate with a cosine of
    threshold or more to one kept before goes; those without a usable vector stay. Greedy, so sequential within a query;
    candidates of a query are those above the floor, and at most `limit` are kept.
    """
    columns = candidates.columns
    joined = candidates.join(queries.select("query_id", F.col("vector").alias("query_vector")), "query_id", "left")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 2:
            return rows[columns]
        query = _unit(rows["query_vector"].iloc[0])
        units = [_unit(v) for v in rows["vector"]]
        near = [float(u @ query) if u is not None and query is not None and len(u) == len(query) else -1.0 for u in units]
        score, priority, place = (rows[c].tolist() for c in ("score", "priority", "ord"))
        order = sorted(range(len(rows)), key=lambda i: (-near[i], -score[i], -priority[i], place[i]))
        kept = unlike(units, order, threshold, limit)
        return rows.iloc[sorted(kept, key=lambda i: (-priority[i], -score[i], place[i]))][columns]

    return joined.groupBy("query_id").applyInPandas(run, candidates.schema)


def tag_dedup(tags: DataFrame, threshold: float) -> DataFrame:
    """Tags (query_id, tag_id, weight, is_core, vector, ...) of a query by weight: one with a cosine above threshold to a
    kept tag gives it a fifth of its weight and its core mark, and goes, as do tags without a usable vector."""
    columns = tags.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "tag_id"], ascending=[False, True]).reset_index(drop=True)
        kept: list[int] = []
        units: dict[int, np.ndarray] = {}
        weight, core = rows["weight"].tolist(), rows["is_core"].tolist()
        for i, v in enumerate(rows["vector"]):
            u = _unit(v)
            if u is None:
                continue
            host = next((k for k in kept if len(units[k]) == len(u) and float(units[k] @ u) > threshold), None)
            if host is None:
                kept.append(i)
                units[i] = u
            else:
                weight[host] += 0.2 * weight[i]
                core[host] = core[host] or core[i]
        rows["weight"], rows["is_core"] = weight, core
        return rows.iloc[kept][columns]

    return tags.groupBy("query_id").applyInPandas(run, tags.schema)


