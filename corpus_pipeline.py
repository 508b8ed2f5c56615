"""The corpus pipeline: five operators, each applied to all that the one before kept.

1. quality: texts that the classifier rejects go.
2. near_duplicates: one text of each group stays (five words, similarity 0.8).
3. decontaminate: texts that hold a benchmark window go.
4. secrets: found secrets are replaced by a mark in the text; every row stays.
5. bpe: every text as token ids, with its decoded form's digest.

All stages: a null or empty text is a text without words, judged as such; repeated rows are rows of their own until near_duplicates leaves one;
ties go to the smallest doc_id; an empty table gives an empty table; further columns, whatever their names, are kept as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanline.llm import bpe, decontaminate, near_dups, quality_model, secret_scan
from spanline.llm.common import cut, dropped, free_name, table, tokenizer_path


def kept_columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of 0.3 or more. A null or empty text is judged by its score like any other; without labels of both kinds every score is 0.5, so all stay."""
    out = free_name(docs, "__quality")
    scored = quality_model.with_scores(docs, table(spark, sf_dir, "labels"), out)
    return scored.where(F.col(f"{out}.score") >= 0.3).select(*kept_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows of null or empty texts are no copies of anything."""
    return near_dups.one_of_each_group(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark window; a null or empty text has none."""
    out = free_name(docs, "__hit")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), out)
    return found.where(~F.col(f"{out}.contaminated")).select(*kept_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced; a null text stays null."""
    return secret_scan.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and decoded text; a null text has no ids."""
    out = free_name(docs, "__bpe")
    found = bpe.encode_texts(docs, tokenizer_path("byte_bpe_50k.json"), out, keep=("ids",))
    return found.select("doc_id", "lang", "source", *[f"{out}.{c}" for c in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("secrets", secrets), ("bpe", encoded)]

#: A trained classifier, hash minima and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; between stages the rows are kept as a table in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
            if k:
                dropped(before)
    return docs
