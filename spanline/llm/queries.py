"""The queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, dialogue_repair, licenses, near_dups, prefix_trie, quality_model, quality_rules, repeats, secret_scan, shards, token_counts, token_files
from .common import table, tokenizer_path


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80).drop("fp", "th")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.own_folder(spark)
    token_files.write_ids(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), folder)
    return token_files.places(spark, folder)


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    return dialogue_repair.audited(dialogue_repair.damaged(convs), convs)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.family_trie(table(spark, sf_dir, "conversations")).drop("digest", "parent")


#: CRC-32 of the letters of a number, bit by bit.
CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"""

OP13 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {CRC} % 6 AS h, conv_id - conv_id % 100 AS head FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT ids.conv_id, place, role, text FROM ids JOIN t ON t.conv_id = head AND place <= h
  UNION ALL SELECT ids.conv_id, place, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id AND place > h),
d AS (SELECT conv_id, role, text, row_number() OVER w AS depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
p AS (
  SELECT conv_id, depth, key, length(text) AS chars FROM d
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
q AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, max(up) AS up,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM q GROUP BY key, depth),
c AS (SELECT up AS key, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (key, depth)),
s AS (
  SELECT p.key, p.depth, sum((v.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((v.n_convs - 1) * v.chars)::BIGINT AS saved_tokens
  FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY 1, 2)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM v JOIN s USING (key, depth) LEFT JOIN n u ON u.key = v.up AND u.depth = v.depth - 1
"""

OPERATORS = (
    op1_bpe, op2_sharding, op3_token_counts, op4_secrets, op5_minhash, op6_quality_rules, op7_suffix_array, op8_quality_classifier, op9_decontamination, op10_licenses, op11_token_files,
    op12_dialogue_repair, op13_prefix_trie,
)
QUERIES = {f.__name__: f for f in OPERATORS}
SQL: dict[str, str] = {"op13_prefix_trie": OP13}
