"""Queries with window functions on segments, frames and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanline.functions import vectors as V
from spanline.operators import windows as W

from .registry import query
from .tables import frames, segments, stage_samples, table, turns_ref, with_tables

RUNS = "r AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_ms, segment_id) AS run FROM (SELECT *, CASE WHEN lag(speaker_id) OVER w = speaker_id AND start_ms - lag(end_ms) OVER w <= 100 THEN 0 ELSE 1 END AS new FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms, segment_id)))"


@query(with_tables("segments", f"WITH {RUNS} SELECT segment_id, recording_id, CAST(run AS BIGINT) AS run, row_number() OVER (PARTITION BY recording_id, run ORDER BY start_ms) AS place, count(*) OVER (PARTITION BY recording_id, run) AS size FROM r"))
def e6_speaker_runs(spark, sf):
    return W.speaker_runs(segments(spark, sf), 100).select("segment_id", "recording_id", "run", "place", "size")


@query(with_tables("segments", f"WITH {RUNS} SELECT recording_id, speaker_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, string_agg(text, ' ' ORDER BY start_ms) AS text FROM r GROUP BY recording_id, speaker_id, run"))
def e21_coalesce_fragments(spark, sf):
    return W.coalesce_runs(segments(spark, sf), 100)


@query(with_tables("segments", "SELECT segment_id, prev, next FROM (SELECT segment_id, lag(text) OVER w AS prev, lead(text) OVER w AS next FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY turn))"))
def e17_neighbour_context(spark, sf):
    w = Window.partitionBy("recording_id").orderBy("turn")
    return segments(spark, sf).select("segment_id", F.lag("text").over(w).alias("prev"), F.lead("text").over(w).alias("next"))


@query("SELECT source, doc_id, lang, prev FROM (SELECT source, doc_id, lang, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents) WHERE prev <> lang")
def e8_switch_points(spark, sf):
    return W.switch_points(table(spark, sf, "documents").select("source", "doc_id", "lang"), ["source"], "doc_id", "lang")


@query(with_tables("frames", """WITH g AS (SELECT recording_id, least(quantile_cont(rms_db, 0.5), quantile_cont(rms_db, 0.05) + 12) AS threshold FROM frames GROUP BY 1)
    SELECT f.recording_id, f.frame_no, rms_db >= threshold AS active, round(coalesce(abs(rms_db - lag(rms_db) OVER w) / 12 + abs(centroid - lag(centroid) OVER w) / 4000 + abs(zcr - lag(zcr) OVER w) / 0.2::DOUBLE, 0), 6) AS change FROM frames f JOIN g USING (recording_id) WINDOW w AS (PARTITION BY f.recording_id ORDER BY frame_no)"""))
def e13_activity_gate(spark, sf):
    return W.activity_gate(frames(spark, sf))


VAD = """WITH g AS (SELECT recording_id, least(quantile_cont(rms_db, 0.5), quantile_cont(rms_db, 0.05) + 12) AS threshold FROM frames GROUP BY 1),
    a AS (SELECT f.recording_id, frame_no, rms_db >= threshold AS active FROM frames f JOIN g USING (recording_id)),
    r AS (SELECT *, sum(CASE WHEN lag IS NOT DISTINCT FROM active THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY frame_no) AS run FROM (SELECT *, lag(active) OVER (PARTITION BY recording_id ORDER BY frame_no) AS lag FROM a))
    SELECT recording_id, frame_no, CASE WHEN active AND n < 2 THEN false WHEN NOT active AND n < 2 THEN true ELSE active END AS active FROM (SELECT *, count(*) OVER (PARTITION BY recording_id, run) AS n FROM r)"""


@query(with_tables("frames", VAD))
def e14_vad_hysteresis(spark, sf):
    return W.least_runs(W.activity_gate(frames(spark, sf)), 2, 2)


@query("SELECT vec_id, round(1 - greatest(-1, least(1, list_cosine_similarity(embedding::DOUBLE[], prev))), 6) AS change FROM (SELECT vec_id, embedding, lag(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS prev FROM embeddings) WHERE prev IS NOT NULL")
def e15_change_score(spark, sf):
    """A recording is fifty vectors in a row."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    prev = F.lag("v").over(Window.partitionBy(F.expr("vec_id div 50")).orderBy("vec_id"))
    return e.withColumn("prev", prev).where("prev IS NOT NULL").select("vec_id", F.round(1 - V.cosine("v", "prev"), 6).alias("change"))


PEAKS = "p AS (SELECT recording_id, start_ms AS t, (event_id % 100) / 100.0::DOUBLE AS score, event_id FROM turns_ref), g AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY t, event_id) AS grp FROM (SELECT *, CASE WHEN t - lag(t) OVER w <= 60000 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY t, event_id)))"


@query(with_tables("turns_ref", f"WITH {PEAKS} SELECT recording_id, t, score, n FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, grp ORDER BY score DESC, t, event_id) AS k, count(*) OVER (PARTITION BY recording_id, grp) AS n FROM g) WHERE k = 1"))
def e16_merge_peaks(spark, sf):
    p = turns_ref(spark, sf).select("recording_id", F.col("start_ms").alias("t"), ((F.col("event_id") % 100) / 100.0).alias("score"), "event_id")
    return W.merge_peaks(p, 60_000)


@query(with_tables("segments", """WITH d AS (SELECT *, end_ms - start_ms + 80 AS step, coalesce(sum(end_ms - start_ms + 80) OVER (PARTITION BY recording_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM segments)
    SELECT segment_id, CAST(before + max(start_ms - before) OVER (PARTITION BY recording_id ORDER BY turn) AS BIGINT) AS cue_start FROM d"""))
def e19_cue_shift(spark, sf):
    return W.shift_cues(segments(spark, sf), 80).select("segment_id", "cue_start")


@query(with_tables("turns_ref", "SELECT recording_id, speaker_id, 'speaker-' || row_number() OVER (PARTITION BY recording_id ORDER BY first, speaker_id) AS canonical FROM (SELECT recording_id, speaker_id, min(start_ms) AS first FROM turns_ref GROUP BY 1, 2)"))
def e20_canonical_numbers(spark, sf):
    return W.canonical_numbers(turns_ref(spark, sf))


@query("SELECT vec_id, len(w) AS n_frames, round(list_sum(w), 6) AS total FROM (SELECT vec_id, list_transform(range(1, len(e) - 16 + 2, 8), lambda i: sqrt(list_dot_product(e[i:i + 15], e[i:i + 15]) / 16)) AS w FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def e26_rms_frames(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", W.rms_frames("v", 16, 8).alias("w")).select("vec_id", F.size("w").cast("long").alias("n_frames"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(with_tables("frames", "SELECT recording_id, frame_no, round((least(l, r) - rms_db) / greatest(abs(least(l, r)), 1e-9), 6) AS depth FROM (SELECT *, lag(rms_db) OVER w AS l, lead(rms_db) OVER w AS r FROM frames WINDOW w AS (PARTITION BY recording_id ORDER BY frame_no)) WHERE rms_db <= l AND rms_db < r AND (least(l, r) - rms_db) / greatest(abs(least(l, r)), 1e-9) >= 0.2"))
def e28_energy_valleys(spark, sf):
    return W.valleys(frames(spark, sf), 0.2)


@query(with_tables("turns_ref", """WITH u AS (SELECT recording_id, start_ms, end_ms FROM turns_ref UNION ALL SELECT DISTINCT recording_id, 30000000, 31000000 FROM turns_ref), i AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN start_ms < max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM u))
    SELECT recording_id, s AS start_ms, e AS end_ms FROM (SELECT recording_id, isl, min(start_ms) AS s, max(end_ms) AS e FROM i GROUP BY 1, 2) WHERE s <= 30000000 AND e >= 31000000"""))
def e29_expand_window(spark, sf):
    return W.expand_window(turns_ref(spark, sf), 30_000_000, 31_000_000)


@query(with_tables("stage_samples", "SELECT stage, count(*) AS n, round(sum(latency_ms), 4) AS total_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, max(latency_ms) AS peak, round(avg(CASE WHEN cache_hit THEN 1 ELSE 0 END), 9) AS hit_rate FROM stage_samples GROUP BY 1"))
def d29_stage_stats(spark, sf):
    return W.stage_stats(stage_samples(spark, sf))


@query(with_tables("segments", """WITH RECURSIVE s AS (SELECT segment_id, recording_id, start_ms, end_ms, speaker_id, round(abs(confidence - 0.5), 9) AS margin, turn % 13 = 12 AS locked, (recording_id + turn) % 17 = 0 AS overlapping, turn % 19 = 18 AS conflict FROM segments),
    w AS (SELECT *, lag(speaker_id) OVER w AS target, coalesce(lag(speaker_id) OVER w = lead(speaker_id) OVER w AND speaker_id <> lag(speaker_id) OVER w, false) AS island, lag(end_ms) OVER w AS left_end, lead(start_ms) OVER w AS right_start,
      lag(overlapping) OVER w AS left_over, lead(overlapping) OVER w AS right_over, row_number() OVER w AS place FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms, end_ms, segment_id)),
    b AS (SELECT *, list_filter([CASE WHEN end_ms - start_ms > 12000 THEN 'DURATION' END, CASE WHEN left_end > start_ms OR end_ms > right_start THEN 'OVERLAP' END, CASE WHEN greatest(0, start_ms - left_end, right_start - end_ms) > 500 THEN 'GAP' END,
      CASE WHEN coalesce(lag(island) OVER w, false) OR coalesce(lead(island) OVER w, false) THEN 'ADJACENT' END, CASE WHEN locked THEN 'LOCKED' END, CASE WHEN overlapping THEN 'OVERLAPPING' END, CASE WHEN left_over OR right_over THEN 'NEIGHBOUR_OVERLAPPING' END,
      CASE WHEN conflict THEN 'BOUNDARY' END, CASE WHEN target NOT IN (speaker_id, CASE WHEN speaker_id = 'user' THEN 'assistant' ELSE 'user' END) THEN 'NOT_IN_TOP' END], lambda x: x IS NOT NULL) AS blockers FROM w WINDOW w AS (PARTITION BY recording_id ORDER BY place)),
    v AS (SELECT *, CASE WHEN NOT island THEN 'NONE' WHEN margin >= 0.4 THEN 'STRONG' WHEN len(blockers) > 0 THEN 'REVIEW' ELSE 'OPEN' END AS verdict FROM b),
    o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY place) AS i FROM v WHERE verdict = 'OPEN'),
    f AS (SELECT recording_id, 0::BIGINT AS i, count(*) FILTER (speaker_id = 'assistant') AS a, count(*) FILTER (speaker_id = 'system') AS s, count(*) FILTER (speaker_id = 'user') AS u, NULL::BIGINT AS place, false AS applied FROM s GROUP BY 1
      UNION ALL SELECT recording_id, i, a + ok * ((target = 'assistant')::INTEGER - (own = 'assistant')::INTEGER), s + ok * ((target = 'system')::INTEGER - (own = 'system')::INTEGER), u + ok * ((target = 'user')::INTEGER - (own = 'user')::INTEGER), place, ok = 1 FROM (
        SELECT f.recording_id, o.i, f.a, f.s, f.u, o.place, o.target, o.speaker_id AS own, (CASE o.speaker_id WHEN 'assistant' THEN f.a WHEN 'system' THEN f.s ELSE f.u END > 1)::INTEGER AS ok FROM f JOIN o ON o.recording_id = f.recording_id AND o.i = f.i + 1))
    SELECT v.segment_id, CASE WHEN applied THEN target ELSE speaker_id END AS fixed, CASE WHEN applied THEN 'APPLIED' WHEN verdict = 'OPEN' THEN 'REVIEW' ELSE verdict END AS verdict,
      CASE WHEN verdict = 'OPEN' AND NOT applied THEN 'LAST_SUPPORT' WHEN verdict = 'REVIEW' THEN array_to_string(blockers, ',') ELSE '' END AS blockers FROM v LEFT JOIN f ON f.recording_id = v.recording_id AND f.place = v.place"""))
def e7_island_repair(spark, sf):
    """Short turns between two of another role; margin, locks and overlaps from segment arithmetic."""
    second = F.when(F.col("speaker_id") == "user", "assistant").otherwise("user")
    own = segments(spark, sf).select(
        "segment_id", "recording_id", "start_ms", "end_ms", "speaker_id", F.round(F.abs(F.col("confidence") - 0.5), 9).alias("margin"), (F.col("turn") % 13 == 12).alias("locked"),
        ((F.col("recording_id") + F.col("turn")) % 17 == 0).alias("overlapping"), (F.col("turn") % 19 == 18).alias("boundary_conflict"), F.array("speaker_id", second).alias("top"),
    )
    return W.repair_islands(own, 12_000, 500, 0.4).select("segment_id", "fixed", "verdict", F.array_join("blockers", ",").alias("blockers"))


@query(with_tables("segments", """WITH RECURSIVE o AS (SELECT recording_id, segment_id, start_ms, end_ms, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, segment_id) AS k FROM segments),
    b AS (SELECT recording_id, segment_id, k, start_ms, end_ms, NULL::BIGINT AS before_end FROM o WHERE k = 1
      UNION ALL SELECT recording_id, segment_id, k, CASE WHEN fits THEN middle ELSE start_ms END, end_ms, CASE WHEN fits THEN middle ELSE last_end END
      FROM (SELECT *, start_ms <> last_end AND start_ms - last_end <= 200 AND last_end - start_ms <= 200 AND middle - last_start >= 500 AND end_ms - middle >= 500 AS fits
        FROM (SELECT o.*, b.start_ms AS last_start, b.end_ms AS last_end, (o.start_ms + b.end_ms) // 2 AS middle FROM b JOIN o ON o.recording_id = b.recording_id AND o.k = b.k + 1)))
    SELECT recording_id, segment_id, start_ms, coalesce(lead(before_end) OVER (PARTITION BY recording_id ORDER BY k), end_ms) AS end_ms FROM b"""))
def e10_smooth_boundaries(spark, sf):
    return W.smooth_boundaries(segments(spark, sf), 200, 200, 500)


@query(with_tables("segments", "SELECT segment_id, recording_id, CASE WHEN prev IS NULL THEN text ELSE substr(text, 1 + coalesce(list_max(list_filter(range(5, least(120, length(prev), length(text)) + 1), lambda n: right(prev, n) = left(text, n))), 0)) END AS text FROM (SELECT *, lag(text) OVER (PARTITION BY recording_id ORDER BY turn) AS prev FROM segments) WHERE prev IS NULL OR lower(trim(prev)) <> lower(trim(text))"))
def e11_dedup_overlap_text(spark, sf):
    return W.dedup_text(segments(spark, sf), 5)


@query(with_tables("segments", "SELECT recording_id, speaker_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY start_ms, text) AS text FROM (SELECT *, sum(new) OVER (PARTITION BY recording_id, speaker_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY recording_id, speaker_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 THEN 0 ELSE 1 END AS new FROM segments)) GROUP BY recording_id, speaker_id, island"))
def e12_merge_with_text(spark, sf):
    return W.merge_with_text(segments(spark, sf), 100)
