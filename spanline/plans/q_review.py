"""Queries on reviews, decisions, cues and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.operators import review as R
from spanline.operators import rules as U
from spanline.operators import windows as W

from .registry import query
from .tables import candidates, reviews, segments, table, turns_ref, with_tables

DEC = "d AS (SELECT 'd' || (turn * 1000 + recording_id) AS decision_id, segment_id, recording_id * 10 + turn AS seq, CASE turn % 3 WHEN 0 THEN 'edit' WHEN 1 THEN 'accept' ELSE 'reject' END AS action, CASE WHEN turn % 3 = 0 THEN text || ' (edited)' END AS text FROM segments WHERE confidence < 0.9)"


def decisions(spark, sf):
    action = F.when(F.col("turn") % 3 == 0, "edit").when(F.col("turn") % 3 == 1, "accept").otherwise("reject")
    return segments(spark, sf).where("confidence < 0.9").select(F.concat(F.lit("d"), (F.col("turn") * 1000 + F.col("recording_id")).cast("string")).alias("decision_id"), "segment_id", (F.col("recording_id") * 10 + F.col("turn")).alias("seq"), action.alias("action"), F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" (edited)"))).alias("text"))


@query(with_tables("segments", "SELECT recording_id, segment_id, reason FROM (SELECT recording_id, segment_id, unnest(list_filter([CASE WHEN confidence < 0.3 THEN 'LOW_CONFIDENCE' END, CASE WHEN end_ms - start_ms > 60000 THEN 'LONG_SEGMENT' END, CASE WHEN length(text) < 20 THEN 'SHORT_TEXT' END], lambda x: x IS NOT NULL)) AS reason FROM segments) UNION ALL SELECT recording_id, '*', 'LOW_MEAN_CONFIDENCE' FROM segments GROUP BY 1 HAVING avg(confidence) < 0.5"))
def l1_review_queue(spark, sf):
    return R.review_queue(segments(spark, sf))


@query(with_tables("segments", f"WITH {DEC}, f AS (SELECT segment_id, arg_max(action, seq) AS action, arg_max(coalesce(text, chr(0)), seq) AS t, count(*) AS n FROM d GROUP BY 1) SELECT s.segment_id, CASE f.action WHEN 'edit' THEN CASE WHEN t = chr(0) THEN s.text ELSE t END WHEN 'reject' THEN NULL ELSE s.text END AS display_text, coalesce(f.action, 'none') AS action, coalesce(n, 0) AS n_revisions FROM segments s LEFT JOIN f USING (segment_id)"))
def c18_apply_decisions(spark, sf):
    return R.apply_decisions(segments(spark, sf), decisions(spark, sf)).select("segment_id", "display_text", "action", "n_revisions")


@query(with_tables("segments", "SELECT segment_id, 'speaker-' || dense_rank() OVER (PARTITION BY recording_id ORDER BY first, sp) AS speaker FROM (SELECT *, min(start_ms) OVER (PARTITION BY recording_id, sp) AS first FROM (SELECT *, CASE speaker_id WHEN 'system' THEN 'assistant' ELSE speaker_id END AS sp FROM segments))"))
def c19_merge_speakers(spark, sf):
    return R.merge_speakers(segments(spark, sf), {"system": "assistant"}).select("segment_id", "speaker")


@query(with_tables("segments", "SELECT segment_id, count(*) FILTER (open) AS n_open, count(*) FILTER (NOT open) AS n_resolved, bool_and(NOT open) AS complete FROM (SELECT segment_id, turn % 4 = 0 AS open FROM segments UNION ALL SELECT segment_id, false FROM segments WHERE confidence < 0.9) GROUP BY 1"))
def l2_resolution(spark, sf):
    s = segments(spark, sf)
    q = s.select("segment_id", F.when(F.col("turn") % 4 == 0, "open").otherwise("done").alias("status")).unionByName(s.where("confidence < 0.9").select("segment_id", F.lit("done").alias("status")))
    return R.resolution(q)


@query(with_tables("segments", "SELECT segment_id, coalesce(CASE WHEN turn % 3 = 0 THEN text || ' (edited)' END, CASE WHEN turn % 2 = 0 THEN lower(text) END, text) AS text, CASE WHEN turn % 3 = 0 THEN 'manual' WHEN turn % 2 = 0 THEN 'composed' ELSE 'raw' END AS source FROM segments"))
def l3_final_transcript(spark, sf):
    s = segments(spark, sf)
    return R.final_text(s, s.where("turn % 3 = 0").select("segment_id", F.concat("text", F.lit(" (edited)")).alias("text")), s.where("turn % 2 = 0").select("segment_id", F.lower("text").alias("text")))


@query(with_tables("candidates", "SELECT domain, group_id, count(*) AS n, count(*) FILTER (eligible) AS n_eligible, max(CASE WHEN current THEN candidate_id END) AS current_id, string_agg(candidate_id::VARCHAR, ',' ORDER BY candidate_id) AS members FROM candidates GROUP BY 1, 2"))
def l4_lattice(spark, sf):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("candidate_id")), lambda x: x.cast("string")), ",")
    return candidates(spark, sf).groupBy("domain", "group_id").agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"), F.max(F.when(F.col("current"), F.col("candidate_id"))).alias("current_id"), ids.alias("members"))


@query(with_tables("candidates", "SELECT domain, group_id, candidate_id, row_number() OVER w AS rank, lag(candidate_id) OVER w AS parent_id, sha256(concat_ws(':', domain, group_id, candidate_id)) AS key FROM candidates WINDOW w AS (PARTITION BY domain, group_id ORDER BY score DESC, candidate_id)"))
def l5_candidate_set(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("domain", "group_id").orderBy(F.desc("score"), "candidate_id")
    return candidates(spark, sf).select("domain", "group_id", "candidate_id", F.row_number().over(w).cast("long").alias("rank"), F.lag("candidate_id").over(w).alias("parent_id"), F.sha2(F.concat_ws(":", "domain", "group_id", "candidate_id").cast("binary"), 256).alias("key"))


@query(with_tables("segments", "WITH r AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_ms, segment_id) AS run FROM (SELECT *, CASE WHEN lag(speaker_id) OVER w = speaker_id AND start_ms - lag(end_ms) OVER w <= 2000 THEN 0 ELSE 1 END AS new FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms, segment_id))) SELECT recording_id, speaker_id, min(start_ms) AS start_ms, count(*) AS n, count(*) FILTER (confidence < 0.3) AS n_unresolved FROM r GROUP BY recording_id, speaker_id, run"))
def l6_continuity_runs(spark, sf):
    runs = W.speaker_runs(segments(spark, sf), 2000)
    return runs.groupBy("recording_id", "speaker_id", "run").agg(F.min("start_ms").alias("start_ms"), F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.3).alias("n_unresolved")).drop("run")


@query(with_tables("candidates", "WITH s AS (SELECT domain, group_id, arg_max(candidate_id, struct_pack(a := score, b := -candidate_id)) AS c, bool_or(eligible) AS ok FROM candidates GROUP BY 1, 2) SELECT group_id, count(*) AS n_domains, bool_and(ok) AS consistent, min(c) AS first_id FROM s GROUP BY 1"))
def l7_cross_domain(spark, sf):
    s = candidates(spark, sf).groupBy("domain", "group_id").agg(F.max_by("candidate_id", F.struct("score", -F.col("candidate_id"))).alias("c"), F.bool_or("eligible").alias("ok"))
    return s.groupBy("group_id").agg(F.count("*").alias("n_domains"), F.bool_and("ok").alias("consistent"), F.min("c").alias("first_id"))


PIECES = r"regexp_extract_all(text, '((?s).{1,84}(?:[\s.,;:!?]|$)|(?s).{1,84})')"
CUES = f"""u AS (SELECT recording_id, turn, start_ms AS s0, end_ms - start_ms AS d, length(text) AS n, unnest({PIECES}) AS text, unnest(range(len({PIECES}))) AS part FROM segments),
    v AS (SELECT *, sum(length(text)) OVER (PARTITION BY recording_id, turn ORDER BY part ROWS UNBOUNDED PRECEDING) AS upto FROM u),
    cues AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY turn, part) AS number, CAST(s0 + floor(d * (upto - length(text)) / n) AS BIGINT) AS start_ms, CAST(s0 + floor(d * upto / n) AS BIGINT) AS end_ms, text FROM v)"""


@query(with_tables("segments", f"WITH {CUES} SELECT * FROM cues"))
def l8_cues(spark, sf):
    return R.cues(segments(spark, sf))


@query(with_tables("segments", f"WITH {CUES}, q AS (SELECT recording_id, unnest(list_filter([CASE WHEN number <> coalesce(lag(number) OVER w + 1, 1) THEN 'NUMBERING' END, CASE WHEN start_ms < lag(end_ms) OVER w THEN 'OVERLAP' END, CASE WHEN end_ms - start_ms < 800 THEN 'TOO_SHORT' END, CASE WHEN end_ms - start_ms > 7000 THEN 'TOO_LONG' END, CASE WHEN length(text) > 84 THEN 'LENGTH' END, CASE WHEN length(text) * 1000 / (end_ms - start_ms) > 20 THEN 'SPEED' END], lambda x: x IS NOT NULL)) AS code FROM cues WINDOW w AS (PARTITION BY recording_id ORDER BY number)) SELECT code, count(*) AS n FROM q GROUP BY 1"))
def l9_cue_audit(spark, sf):
    q = U.cue_issues(R.cues(segments(spark, sf)))
    return q.select(F.explode(F.split("issues", ",")).alias("code")).where("code <> ''").groupBy("code").agg(F.count("*").alias("n"))


@query(with_tables("segments", f"WITH {CUES} SELECT recording_id, count(*) AS n, sha256(string_agg(number || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || trim(text) || chr(10), chr(10) ORDER BY number)) AS srt_sha FROM cues GROUP BY 1"))
def a10_srt(spark, sf):
    """A recording's subtitle file, as its digest."""
    c = R.cues(segments(spark, sf))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("number", R.srt(c).alias("b")))), lambda x: x["b"])
    return c.groupBy("recording_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(blocks, "\n").cast("binary"), 256).alias("srt_sha"))


@query(with_tables("segments", "SELECT recording_id, sha256(string_agg(speaker_id || ': ' || text, chr(10) ORDER BY turn)) AS txt_sha, strlen(string_agg(speaker_id || ': ' || text, chr(10) ORDER BY turn)) AS n_bytes FROM segments GROUP BY 1"))
def a11_text_export(spark, sf):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("speaker_id", F.lit(": "), "text").alias("t")))), lambda x: x["t"]), "\n")
    return segments(spark, sf).groupBy("recording_id").agg(body.alias("b")).select("recording_id", F.sha2(F.col("b").cast("binary"), 256).alias("txt_sha"), F.octet_length("b").cast("long").alias("n_bytes"))


@query(with_tables("segments", """WITH RECURSIVE o AS (SELECT recording_id, segment_id, length(text) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, segment_id) AS k FROM segments),
    b AS (SELECT recording_id, segment_id, k, 0::BIGINT AS batch, 1::BIGINT AS items, n::BIGINT AS chars FROM o WHERE k = 1 UNION ALL SELECT o.recording_id, o.segment_id, o.k, CASE WHEN items >= 3 OR chars + n > 1500 THEN batch + 1 ELSE batch END, CASE WHEN items >= 3 OR chars + n > 1500 THEN 1 ELSE items + 1 END, CASE WHEN items >= 3 OR chars + n > 1500 THEN n ELSE chars + n END FROM b JOIN o ON o.recording_id = b.recording_id AND o.k = b.k + 1)
    SELECT recording_id, segment_id, batch, items, chars FROM b"""))
def l11_bounded_batches(spark, sf):
    return R.bounded_batches(segments(spark, sf), 3, 1500)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
    c AS (SELECT doc_id, i - 1 AS line, length(l) AS n, CAST(floor(coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 800) AS BIGINT) AS chunk FROM l),
    e AS (SELECT *, sum(n + 1) OVER (PARTITION BY doc_id, chunk ORDER BY line DESC) AS to_end FROM c),
    k AS (SELECT doc_id, chunk, lead(chunk) OVER (PARTITION BY doc_id ORDER BY chunk) AS next FROM (SELECT DISTINCT doc_id, chunk FROM c))
    SELECT doc_id, line, chunk, n, false AS repeated FROM c UNION ALL SELECT doc_id, line, next, n, true FROM e JOIN k USING (doc_id, chunk) WHERE to_end <= 200 AND next IS NOT NULL""")
def l13_text_chunks(spark, sf):
    return R.text_chunks(table(spark, sf, "documents"), 800, 200)


@query(with_tables("segments", "SELECT recording_id, count(*) AS n, count(*) FILTER (turn % 4 = 3) AS n_missing, round(avg(CASE WHEN turn % 4 = 3 THEN 0 ELSE 1 END), 9) AS share FROM segments GROUP BY 1"))
def l15_translation_coverage(spark, sf):
    s = segments(spark, sf)
    return R.completeness(s, s.where("turn % 4 <> 3"))


@query(with_tables("reviews", "SELECT review_id, severity FROM reviews WHERE review_id % 2 = 0 UNION ALL SELECT review_id, 'suggested' FROM reviews WHERE review_id % 3 = 0 AND review_id % 2 <> 0"))
def l21_attach_suggestions(spark, sf):
    r = reviews(spark, sf).select("review_id", "severity")
    return R.new_items(r.where("review_id % 2 = 0"), r.where("review_id % 3 = 0").withColumn("severity", F.lit("suggested")), "review_id")


PREF = "SELECT *, rank() OVER (ORDER BY n_critical, n_major, n_minor, credit DESC) AS rank FROM (SELECT r.alias, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'major') AS n_major, count(*) FILTER (severity = 'minor') AS n_minor, round(coalesce(any_value(c.credit), 0), 9) AS credit FROM reviews r LEFT JOIN (SELECT alias, sum(1.0::DOUBLE / k) AS credit FROM (SELECT alias, count(*) OVER (PARTITION BY case_id) AS k FROM reviews WHERE preferred) GROUP BY 1) c USING (alias) GROUP BY 1)"


@query(with_tables("reviews", PREF))
def d28_preferences(spark, sf):
    return R.preferences(reviews(spark, sf))


@query(with_tables("reviews", f"SELECT alias, count(*) OVER () AS n_tied FROM ({PREF}) WHERE rank = 1"))
def f20_winner(spark, sf):
    top = R.preferences(reviews(spark, sf)).where("rank = 1")
    return top.select("alias").crossJoin(top.agg(F.count("*").alias("n_tied")))


@query(with_tables("segments", "SELECT segment_id, CASE WHEN turn % 2 = 0 AND confidence >= 0.5 THEN lower(text) ELSE text END AS text, turn % 2 = 0 AND confidence >= 0.5 AS applied FROM segments"))
def l22_shadow_apply(spark, sf):
    """A copy of the segments with accepted suggestions, for scoring only."""
    s = segments(spark, sf)
    good = s.where("turn % 2 = 0 AND confidence >= 0.5").select("segment_id", F.lower("text").alias("t"))
    return s.join(good, "segment_id", "left").select("segment_id", F.coalesce("t", "text").alias("text"), F.col("t").isNotNull().alias("applied"))


@query(with_tables("turns_ref", "SELECT recording_id, count(*) AS n_speech, bool_or(event_id % 97 = 0) AS asr_on_silence FROM turns_ref GROUP BY 1"))
def l17_vad_consistency(spark, sf):
    return turns_ref(spark, sf).groupBy("recording_id").agg(F.count("*").alias("n_speech"), F.bool_or(F.col("event_id") % 97 == 0).alias("asr_on_silence"))
