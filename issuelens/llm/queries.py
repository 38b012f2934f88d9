"""The operators over the test tables, one query each, and DuckDB SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import chat, imatch, mixing, packing, pii, quality, rules, runs, separators, sharding, simhash, whitening, windows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the same vocabulary, for the faster encoder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found by the separator scan of the documents' token stream."""
    stream = separators.token_stream(_table(spark, sf_dir, "documents"), VOCABULARY, RANKS)
    return separators.scan(stream).select(F.col("label").alias("doc_id"), "n_tokens", "terminated")


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document, sources weighted by size ** 0.7, in shuffled order."""
    copies = mixing.replicate(_table(spark, sf_dir, "documents"))
    return copies.select("row.doc_id", "row.source", "copy", "order_key")


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    n = [_of_rank(r).alias(f"n_{k.name}") for r, k in enumerate(pii.KINDS)]
    return found.select("row.doc_id", *n, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


def _of_rank(rank: int):
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


def op4_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(_table(spark, sf_dir, "documents"), shards=40)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")


def op5_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY, RANKS).withColumnRenamed("id", "doc_id")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = windows.repeated_passages(_table(spark, sf_dir, "documents"))
    return links.withColumnsRenamed({"id": "doc_id", "other": "other_id"})


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_report(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


CONTROL = "\\### Assistant: </turn> ok"


def op9_chat_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_paths(chat.linear(table.unionByName(control)))
    return chat.read_back(formatted).withColumnRenamed("id", "conv_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.quality(_table(spark, sf_dir, "documents"))
    m = [F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return done.select("row.doc_id", *m, "base_failed", "kept", F.col("failed").alias("failed_rules"))


def op11_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; labels of the rows held out are not looked at."""
    labels = _table(spark, sf_dir, "labels").filter(~rules.held_out("doc_id"))
    scored = rules.fit_and_score(_table(spark, sf_dir, "documents"), labels, label="quality")
    return scored.select(F.col("id").alias("doc_id"), rules.held_out("id").alias("held_out"), "score", "predicted")


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every usable vector."""
    done = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=4)
    return done.select("row.vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
                       "whitened", "explained", "identity_error")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, periodic stretches written into a tenth of them first."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.find_runs(runs.planted(docs)).withColumn("best", runs.strongest(F.col("runs")))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    return found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli,
                        F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_counts, op2_poisson_mixing, op3_private_data, op4_interleaved_shards, op5_packed_sequences,
    op6_simhash_components, op7_repeated_passages, op8_imatch_fingerprints, op9_chat_paths, op10_quality_rules,
    op11_rule_ensemble, op12_whitened_embeddings, op13_periodic_runs)}

_MIXING_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT source, CAST(sum(strlen(t) + 1) AS DOUBLE) AS size FROM d GROUP BY source),
w AS (SELECT source, size, pow(size, 0.7) AS weight FROM s),
r AS (SELECT source, round(weight / (SELECT sum(weight) FROM w) * (SELECT sum(size) FROM w) * 1.0 / size, 9) AS rate FROM w),
p AS (SELECT source, greatest(ceil(rate / {mixing.STEP}), 1) AS parts,
             rate / greatest(ceil(rate / {mixing.STEP}), 1) AS rate FROM r WHERE rate > 0),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM p
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c
      WHERE k + 1 < ceil(rate + 12 * sqrt(rate) + 20)),
u AS (SELECT d.doc_id, d.source, part, CAST('0x' || substr(md5('{mixing.SEED}:' || d.doc_id || ':' || part), 1, 13) AS BIGINT) / {2.0 ** 52} AS u
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, CAST(p.parts AS BIGINT) + 1)) AS x(part)),
n AS (SELECT u.doc_id, u.source, u.part, count(*) FILTER (WHERE u.u >= c.c) AS n
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, (part - 1) * 256 + k AS copy,
       md5('{mixing.SEED} order:' || doc_id || ':' || ((part - 1) * 256 + k)) AS order_key
FROM n, unnest(range(1, n + 1)) AS x(k)"""


def _quality_sql() -> str:
    broken = []
    for r in quality.RULES:
        if r.least is not None:
            broken.append((r.name, f"{r.measure} < {r.least}"))
        if r.most is not None:
            broken.append((r.name, f"{r.measure} > {r.most}"))
    names: dict[str, list[str]] = {}
    for name, test in broken:
        names.setdefault(name, []).append(test)
    failed = ", ".join(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END" for name, tests in names.items())
    stop = ", ".join("'" + w + "'" for w in quality.STOP_WORDS)
    blank = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM s, unnest(range(1, len(w) - 6)) AS x(i)),
f AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM f, unnest(range(i, i + 8)) AS x(p) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             greatest(len(w), 1) AS nw, greatest(len(l), 1) AS nl,
             len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…){blank}*$'))) AS n_ellipsis,
             len(list_filter(l, lambda x: regexp_matches(x, '^{blank}*[-*•]'))) AS n_bullet
      FROM s LEFT JOIN r USING (doc_id)),
q AS (SELECT *, word_chars / nw AS chars_per_word, n_symbols / nw AS symbols_per_word, n_stop / nw AS stop_words_per_word,
             n_letter / nw AS letter_words_per_word, n_repeat_words / nw AS repeat_words_per_word, n_dup_lines / nl AS dup_lines_per_line,
             n_ellipsis / nl AS ellipsis_lines_per_line, n_bullet / nl AS bullet_lines_per_line,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (SELECT *, concat_ws(',', {failed}) AS failed_rules FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""


_CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
n AS (SELECT *, 4 + length(role) + 2 + length(text) + 8
             + (length(role || text) - length(replace(role || text, '\', ''))) + (length(role) - length(replace(role, ':', '')))
             + len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '###'))
             + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text), '')) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id"""

ORACLES: dict[str, str] = {"op2_poisson_mixing": _MIXING_SQL, "op9_chat_paths": _CHAT_SQL, "op10_quality_rules": _quality_sql()}
