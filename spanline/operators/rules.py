"""Validation and contract rules: each rule is a column that gives a code or null, so bad rows are listed, not raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def codes(**rules: Column) -> Column:
    """The names of the rules that hold, joined in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()])), ",")


def segment_issues(segments: DataFrame, speakers: list[str]) -> DataFrame:
    """Issues of each segment: bounds, order within its recording, repeated id, unknown speaker, confidence out of range."""
    w = Window.partitionBy("recording_id").orderBy("turn")
    found = codes(
        BAD_BOUNDS=(F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")), NOT_ORDERED=F.coalesce(F.col("start_ms") < F.lag("start_ms").over(w), F.lit(False)),
        REPEATED_ID=F.count("*").over(Window.partitionBy("segment_id")) > 1, UNKNOWN_SPEAKER=~F.col("speaker_id").isin(speakers), LOW_CONFIDENCE=F.col("confidence") < 0.1,
    )
    return segments.withColumn("issues", found)


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows by their issues."""
    return rows.where("issues = ''").drop("issues"), rows.where("issues <> ''")


def n_best(rows: DataFrame, most: int = 8) -> DataFrame:
    """Candidates of each row's list (id, text): at most `most`, blank texts and repeated ids dropped, missing ids named by place."""
    one = rows.select("row_id", F.posexplode(F.slice("nbest", 1, most)).alias("place", "x")).where(F.trim("x.text") != "")
    named = one.select("row_id", "place", F.coalesce(F.col("x.id"), F.concat(F.lit("candidate-"), (F.col("place") + 1).cast("string"))).alias("id"), F.col("x.text").alias("text"))
    first = named.groupBy("row_id", "id").agg(F.min(F.struct("place", "text")).alias("x"))
    rank = F.row_number().over(Window.partitionBy("row_id").orderBy("x.place"))
    return first.select("row_id", rank.cast("long").alias("rank"), "id", F.col("x.text").alias("text"))


def redacted(cases: DataFrame, truth: list[str]) -> DataFrame:
    """cases without truth columns, a flag for each instead."""
    out = cases.select(*[c for c in cases.columns if c not in truth], *[F.col(c).isNotNull().alias(f"has_{c}") for c in truth])
    assert not set(truth) & set(out.columns)
    return out


def contract_codes(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Codes of a JSON answer (columns id, answer): invalid, missing or extra keys, empty text."""
    found = F.json_object_keys("answer")
    wanted = F.array(*map(F.lit, keys))
    bad = F.try_parse_json("answer").isNull()
    out = codes(INVALID_JSON=bad, MISSING_KEY=~bad & (F.size(F.array_except(wanted, F.coalesce(found, F.array().cast("array<string>")))) > 0), EXTRA_KEY=~bad & (F.size(F.array_except(F.coalesce(found, F.array().cast("array<string>")), wanted)) > 0), EMPTY_TEXT=~bad & (F.coalesce(F.get_json_object("answer", "$.text"), F.lit("")) == ""))
    return raw.select("id", out.alias("codes"))


def fenced_json(text: Column) -> Column:
    """The JSON inside a fenced block, or from the first brace to the last; null if it does not parse."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*(\{[\s\S]*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
    body = F.when(fenced != "", fenced).otherwise(bare)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def cue_issues(cues: DataFrame, most_chars: int = 84, least_ms: int = 800, most_ms: int = 7000, speed: float = 20.0) -> DataFrame:
    """Codes of each cue: numbering, overlap with the one before, too short or long, too many characters, read too fast."""
    w = Window.partitionBy("recording_id").orderBy("number")
    d = F.col("end_ms") - F.col("start_ms")
    return cues.withColumn("issues", codes(
        NUMBERING=F.col("number") != F.coalesce(F.lag("number").over(w) + 1, F.lit(1)), OVERLAP=F.coalesce(F.col("start_ms") < F.lag("end_ms").over(w), F.lit(False)), TOO_SHORT=d < least_ms, TOO_LONG=d > most_ms,
        LENGTH=F.length("text") > most_chars, SPEED=F.length("text") * 1000 / d > speed,
    ))


def metric_changes(before: DataFrame, after: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Metrics (key, metric, objective, value) before and after: improved, regressed, unchanged or not-scored."""
    both = before.select("key", "metric", "objective", F.col("value").alias("a")).join(after.select("key", "metric", F.col("value").alias("b")), ["key", "metric"], "full_outer")
    delta = F.when(F.col("objective") == "max", F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b"))
    return both.select("key", "metric", F.when(F.col("a").isNull() | F.col("b").isNull(), "not-scored").when(F.abs(delta) <= tolerance, "unchanged").when(delta > 0, "improved").otherwise("regressed").alias("change"))


def mismatches(stored: DataFrame, recomputed: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Stored metrics (key, metric, value) against recomputed ones: missing on a side, or too far apart."""
    both = stored.select("key", "metric", F.col("value").alias("a")).join(recomputed.select("key", "metric", F.col("value").alias("b")), ["key", "metric"], "full_outer")
    code = F.when(F.col("a").isNull(), "MISSING_STORED").when(F.col("b").isNull(), "MISSING_RECOMPUTED").when(F.abs(F.col("a") - F.col("b")) > tolerance, "DIFFERS")
    return both.select("key", "metric", code.alias("code")).where("code IS NOT NULL")
