"""Queries that render tables as timed-text lines and read them back, and that check inventories and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.sources import formats as S

from .registry import query
from .tables import segments, stage_samples, table, turns_ref, with_tables


def sec(c):
    return F.format_string("%d.%03d", F.floor(F.col(c) / 1000), F.col(c) % 1000)


@query(with_tables("turns_ref", "SELECT recording_id, speaker_id, start_ms, end_ms FROM turns_ref"))
def a2_rttm(spark, sf):
    t = turns_ref(spark, sf).withColumn("d", F.col("end_ms") - F.col("start_ms"))
    lines = t.select(F.concat_ws(" ", F.lit("SPEAKER"), "recording_id", F.lit("1"), sec("start_ms"), sec("d"), F.lit("<NA> <NA>"), "speaker_id", F.lit("<NA> <NA>")).alias("value"))
    extra = spark.createDataFrame([("",), (";; comment",), ("SPEAKER x 1 bad 2 <NA> <NA> y",)], "value string")
    return S.parse_rttm(lines.unionByName(extra))[0]


@query(with_tables("segments", "SELECT recording_id::VARCHAR AS recording_id, speaker_id, start_ms, end_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM segments"))
def a3_stm(spark, sf):
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return S.parse_stm(segments(spark, sf).select(F.concat_ws(" ", F.col("recording_id").cast("string"), F.lit("A"), "speaker_id", sec("start_ms"), sec("end_ms"), text).alias("value")))


@query(with_tables("segments", "SELECT recording_id AS path, speaker_id, start_ms, end_ms, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM segments"))
def a4_textgrid(spark, sf):
    """Each recording rendered as one TextGrid with a tier a speaker, and read back."""
    one = F.concat(F.lit("xmin = "), sec("start_ms"), F.lit("\nxmax = "), sec("end_ms"), F.lit('\ntext = "'), F.regexp_replace("text", r"\s+", " "), F.lit('"\n'))
    tiers = segments(spark, sf).groupBy("recording_id", "speaker_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("t")))), lambda x: x["t"]), "").alias("b"))
    body = F.concat(F.lit('item [1]:\nclass = "IntervalTier"\nname = "'), "speaker_id", F.lit('"\n'), "b")
    files = tiers.groupBy(F.col("recording_id").alias("path")).agg(F.array_join(F.array_sort(F.collect_list(body)), "").alias("value"))
    return S.parse_textgrid(files)


@query(with_tables("segments", "SELECT recording_id AS id, speaker_id, start_ms, end_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM segments"))
def a5_tagged(spark, sf):
    one = F.concat(F.lit("["), "speaker_id", F.lit(" "), sec("start_ms"), F.lit("-"), sec("end_ms"), F.lit("] "), F.regexp_replace("text", r"\s+", " "))
    rows = segments(spark, sf).groupBy(F.col("recording_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("t")))), lambda x: x["t"]), " ").alias("value"))
    return S.parse_tagged(rows)[0]


@query(with_tables("turns_ref", "SELECT recording_id, start_ms, end_ms, speaker_id FROM turns_ref"))
def a6_parallel_arrays(spark, sf):
    packed = turns_ref(spark, sf).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "speaker_id"))).alias("x"))
    return S.from_parallel_arrays(packed.select("recording_id", F.col("x.start_ms").alias("starts"), F.col("x.end_ms").alias("ends"), F.col("x.speaker_id").alias("speakers")))


@query(with_tables("segments", "SELECT recording_id::VARCHAR AS \"documentId\", segment_id AS id, start_ms, end_ms, speaker_id AS speaker, text FROM segments"))
def a1_transcript_json(spark, sf):
    """Documents rendered as JSON and parsed under the fixed schema; bad ones among them stay out."""
    seg = F.array_sort(F.collect_list(F.struct(F.col("segment_id").alias("id"), "start_ms", "end_ms", F.col("speaker_id").alias("speaker"), "text")))
    docs = segments(spark, sf).groupBy(F.col("recording_id").cast("string").alias("documentId")).agg(F.first("language").alias("language"), seg.alias("segments"))
    plain = docs.select(F.to_json(F.struct("documentId", "language", "segments")).alias("value"))
    # each document again, broken, with a repeated key, and with a number that is none
    broken = [F.concat("value", F.lit("{")), F.regexp_replace("value", r"^\{", '{"documentId":"x",'), F.regexp_replace("value", r"^\{", '{"gain":NaN,')]
    raw = plain.select(F.explode(F.array("value", *broken)).alias("value"))
    return S.transcripts(raw)[0].drop("language")


@query()
def a8_inventory(spark, sf):
    return S.inventory(spark, sf, "*.parquet").select(F.regexp_extract("path", r"([^/]+)/?([^/]*)$", 0).alias("name"), "length")


@query()
def a16_identity_from_path(spark, sf):
    return S.identity_from_path(S.inventory(spark, sf, "*.parquet")).groupBy("name").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


@query("SELECT event_id, user_id, event_type FROM events")
def a9_job_events(spark, sf):
    """Events as JSON lines, parsed under the event schema."""
    raw = table(spark, sf, "events").select(F.to_json(F.struct("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")).alias("value"))
    return raw.select(F.from_json("value", S.EVENT).alias("e")).select("e.event_id", "e.user_id", "e.event_type")


@query()
def a12_fingerprint(spark, sf):
    return S.fingerprint(table(spark, sf, "orders")).select("o_orderkey", "fingerprint")


@query(with_tables("segments", "SELECT segment_id, sha256(concat_ws(':', 'v1', segment_id, text)) AS key FROM segments WHERE turn % 3 <> 0"))
def a13_cache_misses(spark, sf):
    """Segments whose content key is not in the cache."""
    s = segments(spark, sf).withColumn("key", F.sha2(F.concat_ws(":", F.lit("v1"), "segment_id", "text").cast("binary"), 256))
    return S.missing_items(s.select("segment_id", "key", "turn"), s.where("turn % 3 = 0"), ["key"]).select("segment_id", "key")


@query(with_tables("stage_samples", "SELECT DISTINCT job_id FROM stage_samples WHERE job_id NOT IN (SELECT job_id FROM stage_samples WHERE stage = 'error' AND event_id % 2 = 0)"))
def a14_resume(spark, sf):
    s = stage_samples(spark, sf)
    return S.missing_items(s.select("job_id").distinct(), s.where("stage = 'error' AND event_id % 2 = 0").select("job_id").distinct(), ["job_id"])
