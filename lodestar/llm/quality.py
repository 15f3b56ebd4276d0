r"""Host-level quality rules.

Every document is held against document rules. Failures are summed by host (its source), and the rate of each rule, and
of failing any of them, on a host is shrunk towards all hosts: rates follow a beta prior whose two parameters come from the
mean and the variance of the rates of all hosts (by moments, weighted by documents), and a host's rate is
(failures + a) / (documents + a + b). A host is rejected when a shrunk rate, less HOST_SURE deviations of its posterior, so
that few documents don't convict a host, exceeds both HOST_RATE, so that most of what goes with it fails, and HOST_TIMES the
rate over all documents, so that a rule that the whole corpus fails rejects no one. Its verdict is joined back to its
documents.

Words are `[^\x20\x09-\x0D]+`. Everything is DataFrame functions. Edge cases: a null or empty text has no words and fails
as short; a null host is a host like any other; repeated rows count as often as they come; null ids are carried; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialize

#: A host is rejected when a shrunk failure rate is above this, and above so many times the rate over all documents, both
#: by so many deviations of its posterior.
HOST_RATE, HOST_TIMES, HOST_SURE = 0.5, 2.0, 2.0
_BLANK = "[\\x20\\x09-\\x0D]+"
RULES = ("short", "repetitive", "symbols", "lines", "word_length")
RATES = (*RULES, "any")


def three_word_windows(words: Column) -> Column:
    """Hashes of all windows of three words; null with fewer words."""
    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))


def metrics(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("text"))
    tight = F.regexp_replace("text", _BLANK, " ")
    rows = rows.withColumn("tight", F.trim(tight)).withColumn("words", F.when(F.col("tight") != "", F.split("tight", " ")).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("windows", three_word_windows(F.col("words")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, _BLANK, "") != "")
    rows = rows.withColumn("lines", lines)
    # Sorted by hash and place, equal windows are neighbours. Most texts have none and need no sort.
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    rows = rows.withColumn("ordered", F.when(again, F.expr("sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))")))
    same = F.expr("transform(filter(ordered, (x, k) -> get(ordered, k - 1).h <=> x.h or get(ordered, k + 1).h <=> x.h), x -> x.i)")
    rows = rows.withColumn("places", F.sort_array(same))
    covered = F.expr("aggregate(places, named_struct('n', 0L, 'end', 0), (a, i) -> named_struct('n', a.n + (i + 3 - greatest(a.end, i)), 'end', i + 3), a -> a.n)")
    return rows.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.replace("tight", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 20 * F.col("n_dup_lines") > n,
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
    }


def host_verdicts(judged: DataFrame) -> DataFrame:
    """(host, host_docs, rates, host_rejected) of documents with a boolean column for each rule."""
    failed = {r: F.col(r) for r in RULES} | {"any": F.greatest(*RULES)}
    hosts = judged.groupBy("host").agg(F.count("*").alias("host_docs"), *(F.count_if(c).alias(r) for r, c in failed.items()))
    n = F.col("host_docs")
    stats = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("docs"), *(F.sum(r).alias(f"f_{r}") for r in RATES), *(F.sum(F.col(r) * F.col(r) / n).alias(f"s_{r}") for r in RATES))
    prior = []
    for r in RATES:
        mean = F.least(F.greatest(F.col(f"f_{r}") / F.col("docs"), F.lit(1e-6)), F.lit(1 - 1e-6))
        spread = F.greatest(F.col(f"s_{r}") / F.col("docs") - mean * mean, F.lit(0.0))
        # Of the spread of rates, the part that draws of host_docs documents don't explain.
        between = F.greatest(spread - mean * (1 - mean) * F.col("hosts") / F.col("docs"), F.lit(1e-6))
        strength = F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0)), F.lit(1e6))
        prior += [mean.alias(f"m_{r}"), strength.alias(f"n_{r}")]
    shrunk = hosts.crossJoin(F.broadcast(stats.select(*prior)))  # one row
    rate = {r: (F.col(r) + F.col(f"m_{r}") * F.col(f"n_{r}")) / (n + F.col(f"n_{r}")) for r in RATES}
    sure = {r: c - HOST_SURE * F.sqrt(c * (1 - c) / (n + F.col(f"n_{r}") + 1)) for r, c in rate.items()}
    over = [(c > HOST_RATE) & (c > HOST_TIMES * F.col(f"m_{r}")) for r, c in sure.items()]
    return shrunk.select("host", "host_docs", *(c.alias(f"rate_{r}") for r, c in rate.items()), F.greatest(*over).alias("host_rejected"))


def judge(docs: DataFrame) -> DataFrame:
    """The metrics of every row of docs (doc_id, text, source), base_failed, host_rejected and kept."""
    found = materialize(metrics(docs), "quality")
    judged = found.withColumns(failures())
    rejected = host_verdicts(judged).filter("host_rejected").select(F.col("host").alias("bad_host"), "host_rejected")
    joined = judged.join(rejected, judged["host"].eqNullSafe(rejected["bad_host"]), "left")
    base = F.col("short") | F.col("repetitive")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("host_rejected").isNull()).alias("kept"), F.col("host_rejected").isNotNull().alias("host_rejected"))
