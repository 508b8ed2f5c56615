"""Queries on turns: merging, sweeping, overlaps, and one timeline scored against another."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.operators import diarization as D
from spanline.operators import evidence as E
from spanline.operators import intervals as I

from .registry import query
from .tables import DAY_MS, turns_by_system, turns_hyp, turns_ref, with_tables

MERGED = """SELECT {keys}, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_turns FROM (
    SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM {table}))
    GROUP BY {keys}, island"""
RS = "recording_id, speaker_id"


def merged(table: str, gap: int = 0, keys: str = RS) -> str:
    return MERGED.format(keys=keys, gap=gap, table=table)


R, H = f"r AS ({merged('turns_ref')})", f"h AS ({merged('turns_hyp')})"
OVER = "SELECT r.recording_id, r.speaker_id AS ref_speaker, h.speaker_id AS hyp_speaker, CAST(sum(least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms)) AS BIGINT) AS overlap_ms FROM r JOIN h ON r.recording_id = h.recording_id AND r.start_ms < h.end_ms AND h.start_ms < r.end_ms GROUP BY ALL"
SWEEP = """c AS (SELECT r.recording_id, greatest(r.start_ms, h.start_ms) AS start_ms, least(r.end_ms, h.end_ms) AS end_ms FROM r JOIN h USING (recording_id, speaker_id) WHERE r.start_ms < h.end_ms AND h.start_ms < r.end_ms),
    e AS (SELECT recording_id, t, sum(r) AS r, sum(h) AS h, sum(c) AS c FROM (
      SELECT recording_id, start_ms AS t, 1 AS r, 0 AS h, 0 AS c FROM r UNION ALL SELECT recording_id, end_ms, -1, 0, 0 FROM r
      UNION ALL SELECT recording_id, start_ms, 0, 1, 0 FROM h UNION ALL SELECT recording_id, end_ms, 0, -1, 0 FROM h
      UNION ALL SELECT recording_id, start_ms, 0, 0, 1 FROM c UNION ALL SELECT recording_id, end_ms, 0, 0, -1 FROM c) GROUP BY 1, 2),
    s AS (SELECT recording_id, lead(t) OVER w - t AS ms, sum(r) OVER w AS r, sum(h) OVER w AS h, sum(c) OVER w AS c FROM e WINDOW w AS (PARTITION BY recording_id ORDER BY t))"""
DER = """SELECT recording_id, CAST(sum(ms * greatest(r - h, 0)) AS BIGINT) AS missed_ms, CAST(sum(ms * greatest(h - r, 0)) AS BIGINT) AS false_alarm_ms, CAST(sum(ms * (least(r, h) - c)) AS BIGINT) AS confusion_ms, CAST(sum(ms * r) AS BIGINT) AS reference_ms FROM s WHERE ms > 0 GROUP BY 1"""
RATE = "round(CASE WHEN reference_ms > 0 THEN (missed_ms + false_alarm_ms + confusion_ms) / reference_ms::DOUBLE END, 9) AS der"


@query(with_tables("turns_ref", merged("turns_ref", 250)))
def e1_merge_turns(spark, sf):
    return I.merge_turns(turns_ref(spark, sf), 250)


@query(with_tables("turns_ref", f"SELECT recording_id, start_ms, end_ms, n_turns FROM ({merged('(SELECT recording_id, start_ms, least(end_ms, 80000000) AS end_ms FROM turns_ref WHERE least(end_ms, 80000000) > start_ms)', 1000, 'recording_id')}) WHERE end_ms - start_ms >= 500000"))
def e2_merge_regions(spark, sf):
    return I.merge_regions(turns_ref(spark, sf), 1000, 500_000, 80_000_000)


@query(with_tables("turns_ref turns_hyp", f"WITH {R}, {H} {OVER}"))
def c1_overlap_matrix(spark, sf):
    return I.overlap_matrix(turns_ref(spark, sf), turns_hyp(spark, sf))


@query(with_tables("turns_ref", f"WITH {R} SELECT *, round(speech_ms / sum(speech_ms) OVER (PARTITION BY recording_id), 9) AS share FROM (SELECT recording_id, speaker_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, count(*) AS n_runs, max(end_ms - start_ms) AS longest_ms FROM r GROUP BY 1, 2)"))
def d1_speaking_time(spark, sf):
    return D.speaking_time(turns_ref(spark, sf))


@query(with_tables("turns_ref", f"SELECT recording_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, count(*) AS n_regions FROM ({merged('turns_ref', 0, 'recording_id')}) GROUP BY 1"))
def d2_speech_union(spark, sf):
    return D.speech_union(turns_ref(spark, sf))


ACTIVE = """a AS (SELECT recording_id, t AS start_ms, lead(t) OVER w AS end_ms, CAST(sum(step) OVER w AS BIGINT) AS active FROM (SELECT recording_id, t, sum(step) AS step FROM (SELECT recording_id, start_ms AS t, 1 AS step FROM r UNION ALL SELECT recording_id, end_ms, -1 FROM r) GROUP BY 1, 2) WINDOW w AS (PARTITION BY recording_id ORDER BY t))"""


@query(with_tables("turns_ref", f"WITH {R}, {ACTIVE} SELECT * FROM a WHERE end_ms > start_ms"))
def e4_active_counts(spark, sf):
    return I.active_counts(I.merge_turns(turns_ref(spark, sf)))


SETS = f"""WITH {R}, {ACTIVE}, x AS (SELECT a.recording_id, a.start_ms, a.end_ms, string_agg(DISTINCT r.speaker_id, '+' ORDER BY r.speaker_id) AS speakers FROM a JOIN r ON a.recording_id = r.recording_id AND r.start_ms < a.end_ms AND a.start_ms < r.end_ms WHERE a.end_ms > a.start_ms AND a.active {{n}} GROUP BY 1, 2, 3)
    SELECT recording_id, speakers{{alias}}, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_ms) AS run FROM (
    SELECT *, CASE WHEN lag(end_ms) OVER w = start_ms AND lag(speakers) OVER w = speakers THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms))) GROUP BY recording_id, speakers, run"""


@query(with_tables("turns_ref", SETS.format(n="= 1", alias=" AS speaker_id")))
def e3_solo_spans(spark, sf):
    return I.solo_spans(turns_ref(spark, sf))


@query(with_tables("turns_ref", SETS.format(n=">= 2", alias="")))
def e5_overlap_regions(spark, sf):
    return I.overlap_regions(turns_ref(spark, sf))


@query(with_tables("turns_ref", "SELECT a.event_id, a.recording_id, a.start_ms, a.end_ms, EXISTS (SELECT 1 FROM turns_ref b WHERE a.recording_id = b.recording_id AND a.event_id <> b.event_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms) AS overlapped FROM turns_ref a"))
def e18_overlap_flags(spark, sf):
    return I.overlap_flags(turns_ref(spark, sf)).drop("speaker_id")


@query(with_tables("turns_ref", "SELECT event_id, recording_id, speaker_id, greatest(start_ms, 20000000) - 20000000 AS start_ms, least(end_ms, 40000000) - 20000000 AS end_ms FROM turns_ref WHERE start_ms < 40000000 AND end_ms > 20000000"))
def b6_clip(spark, sf):
    return I.clip(turns_ref(spark, sf), 20_000_000, 40_000_000)


@query(with_tables("turns_ref turns_hyp", "SELECT DISTINCT recording_id, t FROM (SELECT recording_id, unnest([start_ms, end_ms]) AS t FROM turns_ref UNION ALL SELECT recording_id, unnest([start_ms, end_ms]) FROM turns_hyp UNION ALL SELECT recording_id, unnest([0, 86400000]) FROM turns_ref)"))
def g2_boundary_set(spark, sf):
    ref = turns_ref(spark, sf)
    ends = ref.select("recording_id").distinct().select("recording_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(DAY_MS).cast("long"))).alias("t"))
    return I.boundaries(ref).unionByName(I.boundaries(turns_hyp(spark, sf))).unionByName(ends).distinct()


NEAR = """p AS (SELECT DISTINCT recording_id, unnest([start_ms, end_ms]) AS t FROM r), q AS (SELECT DISTINCT recording_id, unnest([start_ms, end_ms]) AS t FROM h),
    n AS (SELECT recording_id, side, min(d) AS distance FROM (
    SELECT p.recording_id, 'ref' AS side, p.t, least(p.t - a.t, b.t - p.t) AS d FROM p ASOF LEFT JOIN q a ON p.recording_id = a.recording_id AND p.t >= a.t ASOF LEFT JOIN q b ON p.recording_id = b.recording_id AND p.t <= b.t
    UNION ALL SELECT q.recording_id, 'hyp', q.t, least(q.t - a.t, b.t - q.t) FROM q ASOF LEFT JOIN p a ON q.recording_id = a.recording_id AND q.t >= a.t ASOF LEFT JOIN p b ON q.recording_id = b.recording_id AND q.t <= b.t) GROUP BY recording_id, side, t)"""


@query(with_tables("turns_ref turns_hyp", f"WITH {R}, {H}, {NEAR} SELECT recording_id, side, count(*) AS n, CAST(sum(distance) AS BIGINT) AS total_ms, max(distance) AS max_ms FROM n GROUP BY 1, 2"))
def c3_nearest_boundary(spark, sf):
    return D.boundary_distances(turns_ref(spark, sf), turns_hyp(spark, sf)).groupBy("recording_id", "side").agg(F.count("*").alias("n"), F.sum("distance").alias("total_ms"), F.max("distance").alias("max_ms"))


@query(with_tables("turns_ref turns_hyp", f"""WITH {R}, {H}, {NEAR} SELECT *, round(ref_hits / n_ref, 9) AS recall, round(hyp_hits / n_hyp, 9) AS precision, n_ref - ref_hits AS missed, n_hyp - hyp_hits AS spurious FROM (
    SELECT recording_id, count(distance) FILTER (side = 'ref') AS n_ref, count(distance) FILTER (side = 'hyp') AS n_hyp, count(*) FILTER (side = 'ref' AND distance <= 500) AS ref_hits, count(*) FILTER (side = 'hyp' AND distance <= 500) AS hyp_hits,
    round(avg(distance) FILTER (side = 'ref'), 6) AS mean_ms, round(quantile_cont(distance, 0.5) FILTER (side = 'ref'), 6) AS p50_ms, round(quantile_cont(distance, 0.95) FILTER (side = 'ref'), 6) AS p95_ms, max(distance) FILTER (side = 'ref') AS max_ms FROM n GROUP BY 1)"""))
def d6_boundary_quality(spark, sf):
    return D.boundary_quality(turns_ref(spark, sf), turns_hyp(spark, sf))


@query(with_tables("turns_ref turns_hyp", f"WITH {R}, {H}, {SWEEP}, d AS ({DER}) SELECT *, {RATE} FROM d"))
def d3_diarization_error(spark, sf):
    return D.diarization_error(turns_ref(spark, sf), turns_hyp(spark, sf))


@query(with_tables("turns_ref turns_hyp", f"WITH {R}, {H}, {SWEEP}, d AS ({DER}), g AS (SELECT coalesce(split, 'all') AS split, count(*) AS n_cases, CAST(sum(missed_ms) AS BIGINT) AS missed_ms, CAST(sum(false_alarm_ms) AS BIGINT) AS false_alarm_ms, CAST(sum(confusion_ms) AS BIGINT) AS confusion_ms, CAST(sum(reference_ms) AS BIGINT) AS reference_ms FROM (SELECT *, CASE WHEN right(recording_id, 2) < '20' THEN 'development' ELSE 'held-out' END AS split FROM d) GROUP BY GROUPING SETS ((split), ())) SELECT *, {RATE} FROM g"))
def d7_corpus_error(spark, sf):
    cases = D.diarization_error(turns_ref(spark, sf), turns_hyp(spark, sf))
    return D.corpus_error(cases.withColumn("split", F.when(F.substring("recording_id", 9, 2) < "20", "development").otherwise("held-out")))


@query(with_tables("turns_ref turns_hyp", f"WITH {R}, {H}, x AS (SELECT recording_id, speaker_id, sum(least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms)) AS c FROM r JOIN h USING (recording_id, speaker_id) WHERE r.start_ms < h.end_ms AND h.start_ms < r.end_ms GROUP BY 1, 2), a AS (SELECT recording_id, speaker_id, sum(end_ms - start_ms) AS d FROM r GROUP BY 1, 2), b AS (SELECT recording_id, speaker_id, sum(end_ms - start_ms) AS d FROM h GROUP BY 1, 2) SELECT recording_id, count(*) AS n_speakers, round(avg(1 - coalesce(c, 0)::DOUBLE / (a.d + coalesce(b.d, 0) - coalesce(c, 0))), 9) AS jer FROM a LEFT JOIN b USING (recording_id, speaker_id) LEFT JOIN x USING (recording_id, speaker_id) GROUP BY 1"))
def d4_jaccard_error(spark, sf):
    return D.jaccard_error(turns_ref(spark, sf), turns_hyp(spark, sf))


@query(with_tables("turns_ref turns_hyp", f"WITH {R}, {H}, {SWEEP}, o AS (SELECT recording_id, CAST(sum(CASE WHEN r >= 2 THEN ms ELSE 0 END) AS BIGINT) AS ref_ms, CAST(sum(CASE WHEN h >= 2 THEN ms ELSE 0 END) AS BIGINT) AS hyp_ms, CAST(sum(CASE WHEN r >= 2 AND h >= 2 THEN ms ELSE 0 END) AS BIGINT) AS both_ms, sum(CASE WHEN r >= 2 THEN ms * c ELSE 0 END) AS hit, sum(CASE WHEN r >= 2 THEN ms * r ELSE 0 END) AS sp FROM s WHERE ms > 0 GROUP BY 1) SELECT recording_id, ref_ms, hyp_ms, both_ms, round(CASE WHEN ref_ms > 0 THEN both_ms / ref_ms END, 9) AS recall, round(CASE WHEN hyp_ms > 0 THEN both_ms / hyp_ms END, 9) AS precision, round(CASE WHEN ref_ms + hyp_ms > 0 THEN 2 * both_ms / (ref_ms + hyp_ms) END, 9) AS f1, round(CASE WHEN sp > 0 THEN hit / sp END, 9) AS speaker_recall FROM o"))
def d5_overlap_quality(spark, sf):
    return D.overlap_quality(turns_ref(spark, sf), turns_hyp(spark, sf))


BEST = f"""m AS ({OVER}), k AS (SELECT *, row_number() OVER a AS k, row_number() OVER b AS back, lead(overlap_ms, 1, 0) OVER a AS next_ms, sum(overlap_ms) OVER (PARTITION BY recording_id, hyp_speaker) AS all_ms FROM m
    WINDOW a AS (PARTITION BY recording_id, hyp_speaker ORDER BY overlap_ms DESC, ref_speaker), b AS (PARTITION BY recording_id, ref_speaker ORDER BY overlap_ms DESC, hyp_speaker))"""


@query(with_tables("turns_ref turns_hyp", f"WITH {R}, {H}, {BEST} SELECT recording_id, hyp_speaker, ref_speaker, overlap_ms, round(overlap_ms / all_ms, 9) AS ratio FROM k WHERE k = 1 AND back = 1 AND overlap_ms >= 1000 AND overlap_ms / all_ms >= 0.3 AND (overlap_ms - next_ms) / all_ms >= 0.1"))
def c5_mutual_best(spark, sf):
    return D.mutual_best(I.overlap_matrix(turns_ref(spark, sf), turns_hyp(spark, sf)), 0.3)


@query(with_tables("turns_ref turns_hyp", f"""WITH RECURSIVE {R}, {H}, m AS ({OVER}), refs AS (SELECT recording_id, ref_speaker, row_number() OVER (PARTITION BY recording_id ORDER BY ref_speaker) AS k FROM m GROUP BY 1, 2),
    walk AS (SELECT DISTINCT recording_id, 0 AS k, [] ::VARCHAR[] AS used, 0::BIGINT AS total FROM refs
      UNION ALL SELECT w.recording_id, w.k + 1, CASE WHEN m.hyp_speaker IS NULL THEN w.used ELSE list_append(w.used, m.hyp_speaker) END, w.total + coalesce(m.overlap_ms, 0)
      FROM walk w JOIN refs f ON f.recording_id = w.recording_id AND f.k = w.k + 1 JOIN (SELECT recording_id, ref_speaker, hyp_speaker, overlap_ms FROM m UNION ALL SELECT recording_id, ref_speaker, NULL, 0 FROM refs) m ON m.recording_id = f.recording_id AND m.ref_speaker = f.ref_speaker AND (m.hyp_speaker IS NULL OR NOT list_contains(w.used, m.hyp_speaker)))
    SELECT recording_id, max(total) AS mapped_ms FROM walk GROUP BY 1"""))
def c6_optimal_map(spark, sf):
    return D.optimal_map(I.overlap_matrix(turns_ref(spark, sf), turns_hyp(spark, sf))).groupBy("recording_id").agg(F.sum("overlap_ms").alias("mapped_ms"))


@query(with_tables("turns_ref turns_hyp", f"""WITH RECURSIVE {R}, {H}, m AS ({OVER}), refs AS (SELECT recording_id, ref_speaker, row_number() OVER (PARTITION BY recording_id ORDER BY ref_speaker) AS k FROM m GROUP BY 1, 2),
    walk AS (SELECT DISTINCT recording_id, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS ref_speaker, NULL::VARCHAR AS hyp_speaker, NULL::BIGINT AS overlap_ms FROM refs
      UNION ALL SELECT recording_id, k, CASE WHEN hyp_speaker IS NULL THEN used ELSE list_append(used, hyp_speaker) END, ref_speaker, hyp_speaker, overlap_ms FROM (
        SELECT w.recording_id, f.k, w.used, f.ref_speaker, m.hyp_speaker, m.overlap_ms, row_number() OVER (PARTITION BY w.recording_id ORDER BY m.overlap_ms DESC NULLS LAST, m.hyp_speaker) AS place
        FROM walk w JOIN refs f ON f.recording_id = w.recording_id AND f.k = w.k + 1 LEFT JOIN m ON m.recording_id = f.recording_id AND m.ref_speaker = f.ref_speaker AND NOT list_contains(w.used, m.hyp_speaker)) WHERE place = 1)
    SELECT recording_id, ref_speaker, hyp_speaker, overlap_ms FROM walk WHERE hyp_speaker IS NOT NULL"""))
def c22_greedy_map(spark, sf):
    return D.greedy_map(I.overlap_matrix(turns_ref(spark, sf), turns_hyp(spark, sf)))


@query(with_tables("turns_ref turns_hyp", "SELECT count(*) AS n_recordings, round(avg(CASE WHEN a = b THEN 1 ELSE 0 END), 9) AS accuracy, round(avg(abs(a - b)), 9) AS mean_abs_error FROM (SELECT recording_id, coalesce(x.a, 0) AS a, coalesce(y.b, 0) AS b FROM (SELECT recording_id, count(DISTINCT speaker_id) AS a FROM turns_ref GROUP BY 1) x FULL JOIN (SELECT recording_id, count(DISTINCT speaker_id) AS b FROM turns_hyp GROUP BY 1) y USING (recording_id))"))
def d8_count_accuracy(spark, sf):
    return D.count_accuracy(turns_ref(spark, sf), turns_hyp(spark, sf))


ONLY = "SELECT recording_id, speaker_id, 'missed' AS kind FROM (SELECT DISTINCT recording_id, speaker_id FROM {r} EXCEPT SELECT DISTINCT recording_id, speaker_id FROM {h}) UNION ALL SELECT recording_id, speaker_id, 'false_alarm' FROM (SELECT DISTINCT recording_id, speaker_id FROM {h} EXCEPT SELECT DISTINCT recording_id, speaker_id FROM {r})"


@query(with_tables("turns_ref turns_hyp", ONLY.format(r="(SELECT * FROM turns_ref WHERE end_ms - start_ms > 4000000)", h="(SELECT * FROM turns_hyp WHERE end_ms - start_ms > 4200000)")))
def c4_speaker_differences(spark, sf):
    long = lambda df, ms: df.where(F.col("end_ms") - F.col("start_ms") > ms)
    return D.speaker_differences(long(turns_ref(spark, sf), 4_000_000), long(turns_hyp(spark, sf), 4_200_000))


@query(with_tables("turns_ref turns_hyp", "SELECT recording_id, speaker_id FROM turns_ref WHERE end_ms - start_ms > 4500000 EXCEPT SELECT recording_id, speaker_id FROM turns_hyp WHERE end_ms - start_ms > 4500000"))
def g4_speaker_except(spark, sf):
    own = lambda df: df.where(F.col("end_ms") - F.col("start_ms") > 4_500_000).select("recording_id", "speaker_id").distinct()
    return own(turns_ref(spark, sf)).exceptAll(own(turns_hyp(spark, sf)))


@query(with_tables("turns_by_system", f"SELECT recording_id, start_ms, end_ms, n_turns FROM ({merged('turns_by_system', 500, 'recording_id')}) WHERE end_ms - start_ms >= 1000"))
def g1_union_regions(spark, sf):
    return I.merge_regions(turns_by_system(spark, sf), 500, 1000)


@query(with_tables("turns_ref", f"WITH {R} SELECT a.recording_id, a.speaker_id, b.speaker_id AS r_speaker_id, count(*) AS n_conflicts, max(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) AS longest_ms FROM r a JOIN r b ON a.recording_id = b.recording_id AND a.speaker_id < b.speaker_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms WHERE least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 50 GROUP BY 1, 2, 3"))
def c16_time_conflicts(spark, sf):
    return D.time_conflicts(turns_ref(spark, sf))


@query(with_tables("turns_ref turns_by_system", f"WITH {R}, h AS ({merged('(SELECT * FROM turns_by_system)', 0, 'recording_id, speaker_id, system')}), c AS (SELECT r.recording_id, system, greatest(r.start_ms, h.start_ms) AS s, least(r.end_ms, h.end_ms) AS e FROM r JOIN h USING (recording_id, speaker_id) WHERE r.start_ms < h.end_ms AND h.start_ms < r.end_ms) SELECT system, CAST(sum(e - s) AS BIGINT) AS agreed_ms, count(*) AS n_pieces FROM c GROUP BY 1"))
def c20_system_agreement(spark, sf):
    ref = I.merge_turns(turns_ref(spark, sf))
    own = I.merge_turns(turns_by_system(spark, sf), 0, ("recording_id", "speaker_id", "system"))
    return I.overlap_join(ref, own, keys=("recording_id", "speaker_id")).groupBy(F.col("r_system").alias("system")).agg(F.sum("overlap_ms").alias("agreed_ms"), F.count("*").alias("n_pieces"))


@query(with_tables("turns_ref", "SELECT event_id, recording_id, speaker_id, w AS start_ms, w + 1500 AS end_ms FROM (SELECT DISTINCT event_id, recording_id, speaker_id, unnest(list_append(range(start_ms, end_ms - 1500 + 1, 20000), end_ms - 1500)) AS w FROM turns_ref WHERE end_ms - start_ms >= 1500)"))
def e27_sliding_windows(spark, sf):
    return I.sliding_windows(turns_ref(spark, sf), 1500, 20_000)


@query(with_tables("turns_ref", "SELECT s.event_id, count(*) AS n_context, string_agg(t.speaker_id || ':' || t.start_ms, ',' ORDER BY t.start_ms, t.event_id) AS context FROM turns_ref s JOIN turns_ref t ON s.recording_id = t.recording_id AND s.event_id <> t.event_id AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms GROUP BY 1"))
def c12_timeline_context(spark, sf):
    return E.timeline_context(turns_ref(spark, sf))
