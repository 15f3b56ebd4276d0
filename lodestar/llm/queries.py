"""Queries opN_<name> over the driver's tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.llm import chat, decontaminate, jaccard_join, licenses, packing, quality, secrets, sharding, token_files, toxicity
from lodestar.llm.common import json_rows, table

SHARDS = 24


def op1_sharding(spark, sf_dir):
    out = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op2_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_links(table(spark, sf_dir, "documents"))


#: A conversation that holds the template's own control strings.
PROBE = r'[{"turn":0,"role":"user"},{"turn":1,"role":"assistant"}]'
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def op5_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    probe = json_rows(spark, PROBE, "turn bigint, role string").select(F.lit(PROBE_ID).cast("long").alias("conv_id"), "turn", "role", F.lit(PROBE_TEXT).alias("text"))
    turns = chat.parse(chat.format_rows(rows.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == chat.TRAINED_ROLE), lambda t: t["text"]), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op7_token_files(spark, sf_dir):
    return token_files.token_file_index(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op8_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_license_scan, op3_toxicity, op4_jaccard_join, op5_chat_format, op6_packing, op7_token_files, op8_decontamination, op9_quality_rules, op10_secret_scan)}
def _oracle() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express whole: op5 and op9."""
    said = "concat(r, chr(10), t, chr(10))"
    signs = " + ".join(f"length(replace({c}, '{x}', '{x}{x}'))" for c, x in (("r", "<"), ("t", "<"))) + r" + 2 * length(concat(r, t)) - length(replace(concat(r, t), '\', '')) - length(concat(r, t))"
    chat_sql = f"""WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT {PROBE_ID}, turn, r, '{PROBE_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg({said}, '' ORDER BY turn, r, t)) AS turns_sha256, CAST(coalesce(sum(length(t)) FILTER (WHERE r = '{chat.TRAINED_ROLE}'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = '{chat.TRAINED_ROLE}'), '')) AS loss_sha256, CAST(sum({len(chat.TURN) + len(chat.TEXT) + len(chat.END)} + {signs}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""
    rules = {"short": "n_words < 50", "repetitive": "100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > n_words", "lines": "20 * n_dup_lines > n_words", "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words"}
    failed = rules | {"any": " OR ".join(f"({x})" for x in rules.values())}
    rates = " UNION ALL ".join(f"SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE {x}) AS DOUBLE) AS f, '{name}' AS rule FROM m GROUP BY host" for name, x in failed.items())
    quality_sql = rf"""WITH d AS (SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM d),
g AS (SELECT rid, i, words[i:i + 2] AS gram FROM w, LATERAL (SELECT unnest(range(1, len(words) - 1)) AS i)), again AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (rid)),
h AS ({rates}),
s AS (SELECT rule, count(*) AS hosts, sum(n) AS docs, least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS mean, sum(f * f / n) / sum(n) AS square FROM h GROUP BY rule),
p AS (SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(greatest(square - mean * mean, 0) - mean * (1 - mean) * hosts / docs, 1e-6) - 1, 1), 1e6) AS strength FROM s),
r AS (SELECT host, mean, (f + mean * strength) / (n + strength) AS rate, n + strength + 1 AS size FROM h JOIN p USING (rule)),
bad AS (SELECT DISTINCT host, true AS rejected FROM r WHERE rate - {quality.HOST_SURE} * sqrt(rate * (1 - rate) / size) > greatest({quality.HOST_RATE}, {quality.HOST_TIMES} * mean))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed, coalesce(rejected, false) AS host_rejected, NOT base AND NOT coalesce(rejected, false) AS kept FROM (SELECT *, {rules['short']} OR {rules['repetitive']} AS base FROM m) x LEFT JOIN bad ON bad.host IS NOT DISTINCT FROM x.host"""
    return {"op5_chat_format": chat_sql, "op9_quality_rules": quality_sql}


ORACLE = _oracle()
