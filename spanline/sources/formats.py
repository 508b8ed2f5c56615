"""Readers of timed-text formats: lines or whole files to typed rows, bad ones to a second frame; and file inventories."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType())])
TRANSCRIPT = T.StructType([T.StructField("documentId", T.StringType()), T.StructField("language", T.StringType()), T.StructField("segments", T.ArrayType(SEGMENT)), T.StructField("_corrupt_record", T.StringType())])
EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def seconds_ms(text: str):
    """Seconds as text to whole milliseconds, halves to even."""
    return F.bround(F.col(text).cast("double") * 1000).cast("long")


def is_strict_json(text: str | None) -> bool:
    """Whether a text is a JSON document without repeated keys in an object and without NaN or infinite numbers."""

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def number(text: str) -> float:
        value = float(text)
        if value in (float("inf"), float("-inf")):
            raise ValueError("not finite")
        return value

    def refuse(name: str):
        raise ValueError(name)

    try:
        json.loads(text or "", object_pairs_hook=unique, parse_constant=refuse, parse_float=number)
    except (ValueError, RecursionError):
        return False
    return True


def strict_json(text: str | Column) -> Column:
    """is_strict_json by Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(is_strict_json).astype("bool")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")(text)


def transcripts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, bad) of JSON documents (column value); those that are not strict JSON or lack an id are kept as text."""
    parsed = raw.select("value", F.from_json("value", TRANSCRIPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"), F.coalesce(strict_json("value"), F.lit(False)).alias("strict"))
    ok = F.col("strict") & F.col("d._corrupt_record").isNull() & F.col("d.documentId").isNotNull()
    return parsed.where(ok).select("d.documentId", "d.language", F.inline("d.segments")), parsed.where(~ok).select("value")


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, bad): JSON documents, one a line; those that do not parse are kept as text."""
    return transcripts(spark.read.text(path))


def parse_rttm(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, bad) of RTTM lines (column value); blank lines and comments are left out, repeated lines stay."""
    own = lines.select(F.trim("value").alias("line")).where("line <> '' AND NOT line LIKE ';%'").withColumn("p", F.split("line", r"\s+"))
    typed = own.select("line", F.col("p")[0].alias("kind"), F.try_element_at("p", F.lit(2)).alias("recording_id"), F.try_element_at("p", F.lit(4)).try_cast("double").alias("s"), F.try_element_at("p", F.lit(5)).try_cast("double").alias("d"), F.try_element_at("p", F.lit(8)).alias("speaker_id"))
    ok = F.coalesce((F.col("kind") == "SPEAKER") & (F.col("s") >= 0) & (F.col("d") > 0) & F.col("speaker_id").isNotNull(), F.lit(False))
    ms = lambda c: F.bround(c * 1000).cast("long")
    good = typed.where(ok).select("recording_id", "speaker_id", ms(F.col("s")).alias("start_ms"), ms(F.col("s") + F.col("d")).alias("end_ms"))
    return good, typed.where(~ok).select("line")


def parse_stm(lines: DataFrame) -> DataFrame:
    """recording, channel, speaker, start, end and text of STM lines (column value)."""
    p = r"^(\S+)\s+(\S+)\s+(\S+)\s+([0-9.]+)\s+([0-9.]+)\s+(.*)$"
    g = lambda k: F.regexp_extract("value", p, k)
    rows = lines.where(F.col("value").rlike(p)).select(g(1).alias("recording_id"), g(3).alias("speaker_id"), g(4).alias("s"), g(5).alias("e"), g(6).alias("text"))
    return rows.select("recording_id", "speaker_id", seconds_ms("s").alias("start_ms"), seconds_ms("e").alias("end_ms"), "text")


def parse_textgrid(files: DataFrame) -> DataFrame:
    """One row for each non-empty interval of whole TextGrid files (columns path, value)."""
    tiers = files.select("path", F.posexplode(F.split("value", r"item \[\d+\]:")).alias("tier", "body")).where("tier > 1 OR (tier = 1 AND body LIKE '%name%')")
    named = tiers.select("path", F.regexp_extract("body", r'name = "([^"]*)"', 1).alias("speaker_id"), *[F.regexp_extract_all("body", F.lit(r'xmin = ([0-9.]+)\s+xmax = ([0-9.]+)\s+text = "([^"]*)"'), F.lit(k)).alias(n) for k, n in ((1, "s"), (2, "e"), (3, "t"))])
    rows = named.select("path", "speaker_id", F.inline(F.arrays_zip("s", "e", "t"))).where(F.trim("t") != "")
    return rows.select("path", "speaker_id", seconds_ms("s").alias("start_ms"), seconds_ms("e").alias("end_ms"), F.col("t").alias("text"))


def parse_tagged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, issues) of `[speaker start-end] text` transcripts (columns id, value); turns without length are issues."""
    p = r"\[(\S+) ([0-9.]+)-([0-9.]+)\] ([^\[]*)"
    parts = rows.select("id", *[F.regexp_extract_all("value", F.lit(p), F.lit(k)).alias(n) for k, n in ((1, "speaker_id"), (2, "s"), (3, "e"), (4, "text"))])
    one = parts.select("id", F.inline(F.arrays_zip("speaker_id", "s", "e", "text"))).select("id", "speaker_id", seconds_ms("s").alias("start_ms"), seconds_ms("e").alias("end_ms"), F.trim("text").alias("text"))
    return one.where("end_ms > start_ms"), one.where("end_ms <= start_ms")


def from_parallel_arrays(rows: DataFrame) -> DataFrame:
    """Turns from parallel arrays starts, ends and speakers of equal sizes."""
    fits = rows.where("size(starts) = size(ends) AND size(ends) = size(speakers)")
    return fits.select("recording_id", F.inline(F.arrays_zip(F.col("starts").alias("start_ms"), F.col("ends").alias("end_ms"), F.col("speakers").alias("speaker_id"))))


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path with size and time; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def identity_from_path(files: DataFrame) -> DataFrame:
    """Table and part number from paths like .../name.parquet/part-0001.parquet or .../name.parquet."""
    return files.select("path", "length", F.regexp_extract("path", r"/([a-z]+)\.parquet", 1).alias("name"), F.regexp_extract("path", r"part-(\d+)", 1).alias("part"))


def fingerprint(df: DataFrame) -> DataFrame:
    """df with the SHA-256 of its columns as JSON in the order of their names, nulls written."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return df.withColumn("fingerprint", F.sha2(whole.cast("binary"), 256))


def missing_items(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed or cached job has still to compute."""
    return wanted.join(done.select(*keys), keys, "left_anti")
