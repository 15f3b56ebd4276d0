"""Toxicity by a classifier chain.

The chain predicts label columns one after the other; the probabilities of the earlier ones are features of the later.
While it is trained, those are out-of-fold predictions, so that a later model meets probabilities as uncertain as those
it will get for new texts. Each link is a logistic regression with a ridge penalty on the presence of words and of word
beginnings of PREFIXES bytes (by 64-bit hash), the log of the number of words, the share of punctuation and the earlier
probabilities. Beginnings find inflected forms that the sample lacks.

The chain is fitted on at most SAMPLE_ROWS labelled documents, those with the smallest hash of doc_id; words are chosen
by their counts over that whole sample for the final models, and over the other folds for out-of-fold predictions, which
so know nothing of the documents they are for. Every document is scored on its whole text.

Edge cases: documents without text are scored as texts without words; labels with a null id or value are ignored, of
several labels of one document, or of equal texts, the largest of each column holds, and equal texts are one row of the
sample; where no label can be
joined, or a column has one value only, its probability is the constant share; repeated rows are scored alike; other
columns pass through `filter_toxic` unchanged; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import materialize
from lodestar.llm.hashing import NOT_ALNUM, slices, words

#: Bound of the labelled sample that the chain is fitted on.
SAMPLE_ROWS = 12_000
PREFIXES = (4, 5, 6)
#: Words chosen for each label, documents that hold them at least, and the least |z| of their rates.
WORDS_EACH, WORD_DOCS, WORD_Z = 256, 4, 5.5
FOLDS, RIDGE, STEPS = 4, 0.5, 12
#: A document is toxic from this probability on; toxic ones are few, so their prior is low.
THRESHOLD = 0.35
CHAIN = ("low_quality", "toxic")
_MARKS = np.array([c < 128 and chr(c) in "#*$%&|<>@^~=+_{}[]" for c in range(256)])


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(hashes of words and beginnings, document of each, dense columns, first row) by slice of texts."""
    for lo, hi, data, offsets in slices(column):
        found, firsts, starts = words(data, offsets, NOT_ALNUM, PREFIXES)
        counts = np.diff(firsts)
        doc = np.repeat(np.arange(hi - lo), counts)
        marks = np.concatenate([[0], np.cumsum(_MARKS[data])])[offsets]
        dense = np.stack([np.log1p(counts) / 8, np.minimum(1, np.diff(marks) / np.maximum(1, np.diff(offsets)) * 10)], axis=1)
        yield np.concatenate([found, *(h for _, h in starts)]), np.concatenate([doc, *(doc[w] for w, _ in starts)]), dense, lo


@dataclass
class Chain:
    words: np.ndarray  # sorted hashes
    weights: list[np.ndarray]  # one vector for each link: words, dense columns, earlier probabilities, constant

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probabilities, a row for each text and a column for each link."""
        out = np.zeros((len(column), len(self.weights)))
        for found, doc, dense, lo in _features(column):
            at = np.minimum(np.searchsorted(self.words, found), max(0, len(self.words) - 1))
            known = self.words[at] == found if len(self.words) else np.zeros(len(found), bool)
            pairs = np.unique(doc[known] * np.int64(max(1, len(self.words))) + at[known])
            doc, at = np.divmod(pairs, max(1, len(self.words)))
            n = len(dense)
            for k, w in enumerate(self.weights):
                m = len(self.words)
                total = np.bincount(doc, w[:m][at], minlength=n) if len(at) else np.zeros(n)
                total += np.concatenate([dense, out[lo : lo + n, :k], np.ones((n, 1))], axis=1) @ w[m:]
                out[lo : lo + n, k] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return out


def fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last column of x is the constant, without penalty."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return w
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * np.maximum(p * (1 - p), 1e-6).astype(x.dtype)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, views: dict[int | None, np.ndarray] | None = None) -> list[np.ndarray]:
    """Weights of each column of y in turn, given the out-of-fold probabilities of those before it. views: the columns of x
    that the final models see (None), and those that a model without a fold sees; all where it isn't given."""
    weights, earlier = [], np.zeros((len(y), 0))
    ones, every = np.ones((len(y), 1)), np.arange(x.shape[1])
    seen = lambda f: every if views is None else views[f]
    for k in range(y.shape[1]):
        # With its copies, a view of x is what the driver holds most.
        view = lambda f, earlier=earlier: np.concatenate([x[:, seen(f)], earlier, ones], axis=1, dtype=np.float32)
        weights.append(fit_linear(view(None), y[:, k]))
        held = np.zeros(len(y))
        for f in np.unique(fold):
            mine = view(int(f))
            w = fit_linear(mine[fold != f], y[fold != f, k])
            held[fold == f] = 1 / (1 + np.exp(-np.clip(mine[fold == f] @ w, -35, 35)))
        earlier = np.concatenate([earlier, held[:, None]], axis=1)
    return weights


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit the chain low_quality, toxic on docs (doc_id, text) and labels (doc_id, quality, toxic)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in CHAIN)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    known = F.broadcast(materialize(known, "labelled"))  # SAMPLE_ROWS rows of 16 bytes at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id")
    rows = rows.withColumn("key", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, dense = [], []
            for w, doc, d, _ in _features(batch.column("text")):
                order = np.argsort(doc, kind="stable")
                w, cuts = w[order], np.searchsorted(doc[order], np.arange(len(d) + 1))
                found += [np.unique(w[a:b]).view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                dense += d.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(batch.column(c) for c in CHAIN), pa.array([x.tolist() for x in found], pa.list_(pa.int64())), pa.array(dense, pa.list_(pa.float64()))], ["key", *CHAIN, "words", "dense"])

    sample = rows.mapInArrow(run, "key long, low_quality int, toxic int, words array<long>, dense array<double>")
    # One row for each text, repeated doc_ids included: the sample stays bounded.
    sample = sample.groupBy("key").agg(*(F.max(c).alias(c) for c in CHAIN), F.first("words").alias("words"), F.first("dense").alias("dense"))
    sample = materialize(sample.orderBy("key").limit(SAMPLE_ROWS).withColumn("fold", F.pmod("key", F.lit(FOLDS))), "sample")
    if sample.isEmpty():
        return Chain(np.zeros(0, np.uint64), [np.zeros(3 + k) - 35.0 * (np.arange(3 + k) == 2 + k) for k in range(len(CHAIN))])
    words_of = _chosen_words(sample)
    vocabulary = np.sort(np.array(sorted(set().union(*words_of.values())), dtype=np.int64).view(np.uint64))
    wanted = F.array(*(F.lit(int(x)).cast("long") for x in vocabulary.view(np.int64))) if len(vocabulary) else F.array().cast("array<long>")
    found = sample.select("key", "fold", *CHAIN, "dense", F.array_intersect("words", wanted).alias("words")).orderBy("key").collect()  # SAMPLE_ROWS at most
    x = np.zeros((len(found), len(vocabulary) + 2), np.float32)
    for i, r in enumerate(found):
        if r["words"]:
            x[i, np.searchsorted(vocabulary, np.array(r["words"], np.int64).view(np.uint64))] = 1
        x[i, -2:] = r["dense"]
    y = np.array([[r[c] for c in CHAIN] for r in found], dtype=float)
    columns = {v: np.searchsorted(vocabulary, np.sort(np.array(sorted(w), dtype=np.int64).view(np.uint64))) for v, w in words_of.items()}
    views = {v: np.append(c, [len(vocabulary), len(vocabulary) + 1]) for v, c in columns.items()}
    return Chain(vocabulary[columns[None]], fit_chain(x, y, np.array([r["fold"] for r in found]), views))


def _chosen_words(sample: DataFrame) -> dict[int | None, set[int]]:
    """For each fold, and for none (None), the hashes of at most WORDS_EACH words for each label whose rate among the
    documents outside the fold differs most."""
    folds = range(FOLDS)
    parts = {(c, f): F.sum(F.when(F.col("fold") == f, F.col(c) if c != "n" else 1).otherwise(0)) for c in ("n", *CHAIN) for f in folds}
    sums = [v.alias(f"{c}_{f}") for (c, f), v in parts.items()]
    total = sample.agg(*sums).first()
    counts = sample.select(F.explode("words").alias("word"), "fold", *CHAIN).groupBy("word").agg(*sums)
    rates = []
    for view in (None, *folds):
        mine = [f for f in folds if f != view]
        n, all_n = sum(F.col(f"n_{f}") for f in mine), sum(total[f"n_{f}"] for f in mine)
        for c in CHAIN:
            share = min(max(sum(total[f"{c}_{f}"] for f in mine) / max(1, all_n), 0.5 / max(1, all_n)), 1 - 0.5 / max(1, all_n))
            z = (sum(F.col(f"{c}_{f}") for f in mine) - n * share) / F.sqrt(n * share * (1 - share))
            rates.append(F.struct(F.lit(view).cast("int").alias("view"), F.lit(c).alias("label"), F.when(n >= WORD_DOCS, F.abs(z)).alias("z")))
    each = counts.select("word", F.inline(F.array(*rates))).filter(F.col("z") >= WORD_Z)
    rank = F.row_number().over(Window.partitionBy("view", "label").orderBy(F.desc("z"), "word"))
    found: dict[int | None, set[int]] = {v: set() for v in (None, *folds)}
    for r in each.withColumn("r", rank).filter(F.col("r") <= WORDS_EACH).select("view", "word").collect():  # WORDS_EACH for each fold and label at most
        found[r["view"]].add(r["word"])
    return found


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, is_toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= THRESHOLD)], ["doc_id", "p_low_quality", "p_toxic", "is_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, p_low_quality double, p_toxic double, is_toxic boolean")


def filter_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs that the chain does not find toxic, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at))[:, 1] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
