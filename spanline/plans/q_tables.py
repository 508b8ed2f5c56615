"""Queries on rules, evidence joins, candidates and run audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanline.operators import evidence as E
from spanline.operators import intervals as I
from spanline.operators import rules as U

from .registry import query
from .tables import candidates, doc_pairs, eval_cases, frames, reviews, segments, stage_samples, table, turns_by_system, turns_hyp, turns_ref, with_tables


def flags(*pairs: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL), ',')"


@query(with_tables("segments", "SELECT segment_id, issues FROM (SELECT segment_id, " + flags(("BAD_BOUNDS", "start_ms < 0 OR end_ms <= start_ms"), ("NOT_ORDERED", "coalesce(start_ms < lag(start_ms) OVER (PARTITION BY recording_id ORDER BY turn), false)"), ("REPEATED_ID", "count(*) OVER (PARTITION BY segment_id) > 1"), ("UNKNOWN_SPEAKER", "speaker_id NOT IN ('user', 'assistant')"), ("LOW_CONFIDENCE", "confidence < 0.1")) + " AS issues FROM segments) WHERE issues <> ''"))
def b1_segment_issues(spark, sf):
    return U.split_quarantine(U.segment_issues(segments(spark, sf), ["user", "assistant"]))[1].select("segment_id", "issues")


@query("WITH o AS (SELECT doc_id AS row_id, unnest([lang, NULL, lang, 'x', NULL]) AS id, unnest([source, ' ', lang, text, 'z']) AS text, unnest(range(5)) AS place FROM documents), n AS (SELECT row_id, place, coalesce(id, 'candidate-' || (place + 1)) AS id, text FROM o WHERE trim(text) <> ''), f AS (SELECT row_id, id, min(place) AS place, arg_min(text, place) AS text FROM n GROUP BY 1, 2) SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY place) AS rank, id, text FROM f")
def b8_n_best(spark, sf):
    item = lambda i, t: F.struct(i.alias("id"), t.alias("text"))
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.array(item(F.col("lang"), F.col("source")), item(none, F.lit(" ")), item(F.col("lang"), F.col("lang")), item(F.lit("x"), F.col("text")), item(none, F.lit("z"))).alias("nbest"))
    return U.n_best(rows)


@query(with_tables("eval_cases", "SELECT case_id, split, language, source, n_chars, truth_eligible, wer IS NOT NULL AS has_wer, speaker_count IS NOT NULL AS has_speaker_count FROM eval_cases"))
def b10_redacted(spark, sf):
    return U.redacted(eval_cases(spark, sf).drop("scenarios", "media_sha"), ["wer", "speaker_count"])


ANSWER = "CASE event_id % 4 WHEN 0 THEN '{\"text\": \"' || event_type || '\", \"score\": 1}' WHEN 1 THEN '{\"text\": \"\"}' WHEN 2 THEN 'not json' ELSE '{\"text\": \"a\", \"score\": 2, \"more\": 3}' END"


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'MISSING_KEY,EMPTY_TEXT' WHEN 2 THEN 'INVALID_JSON' ELSE 'EXTRA_KEY' END AS codes FROM events")
def b12_contract_codes(spark, sf):
    return U.contract_codes(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr(ANSWER.replace("%", "%")).alias("answer")), ["text", "score"])


@query("SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN json_extract_string(props, '$.k')::BIGINT END AS k FROM events")
def b13_fenced_json(spark, sf):
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("It is "), "props", F.lit(" so."))).otherwise("{broken")
    return table(spark, sf, "events").select("event_id", F.get_json_object(U.fenced_json(text), "$.k").cast("long").alias("k"))


@query(with_tables("candidates", "SELECT domain, group_id, candidate_id, " + flags(("NOT_ELIGIBLE", "NOT eligible"), ("LOW_SCORE", "score < 0.2"), ("NOT_TOP", "row_number() OVER (PARTITION BY domain, group_id ORDER BY score DESC, candidate_id) > 2")) + " AS codes FROM candidates"))
def b14_suggestion_codes(spark, sf):
    top = F.row_number().over(Window.partitionBy("domain", "group_id").orderBy(F.desc("score"), "candidate_id"))
    return candidates(spark, sf).select("domain", "group_id", "candidate_id", U.codes(NOT_ELIGIBLE=~F.col("eligible"), LOW_SCORE=F.col("score") < 0.2, NOT_TOP=top > 2).alias("codes"))


TOKENS = "t AS (SELECT recording_id, segment_id, turn, i, w, start_ms + (end_ms - start_ms) * i // n AS s, start_ms + (end_ms - start_ms) * (i + 1) // n AS e FROM (SELECT *, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i, len(string_split(text, ' ')) AS n FROM segments))"


@query(with_tables("segments", f"WITH {TOKENS} SELECT recording_id, k AS win, count(*) AS n_tokens, string_agg(w, ' ' ORDER BY s, turn, i) AS text FROM (SELECT *, (s + e) // 2 // 20000 AS k FROM t) GROUP BY 1, 2"))
def c2_tokens_to_windows(spark, sf):
    """Tokens, with equal shares of their segment's time, put into 20 s windows by their middle."""
    s = segments(spark, sf)
    w = s.select("recording_id", "turn", "start_ms", "end_ms", F.size(F.split("text", " ")).alias("n"), F.posexplode(F.split("text", " ")).alias("i", "w"))
    at = lambda k: F.expr(f"start_ms + (end_ms - start_ms) * ({k}) div n")
    t = w.select("recording_id", "turn", "i", "w", at("i").alias("s"), at("i + 1").alias("e")).withColumn("win", F.expr("(s + e) div 2 div 20000"))
    return t.groupBy("recording_id", "win").agg(F.count("*").alias("n_tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "turn", "i", "w"))), lambda x: x["w"]), " ").alias("text"))


@query(with_tables("segments", "SELECT segment_id FROM (SELECT segment_id, count(*) OVER (PARTITION BY recording_id, speaker_id, text) AS a FROM segments) WHERE a = 1 AND segment_id NOT IN (SELECT segment_id FROM segments WHERE turn % 5 = 0)"))
def c9_truth_alignment(spark, sf):
    """Segments with exactly one match of the same speaker and text, and no override."""
    s = segments(spark, sf)
    one = s.groupBy("recording_id", "speaker_id", "text").agg(F.count("*").alias("a"), F.first("segment_id").alias("segment_id")).where("a = 1")
    return one.join(s.where("turn % 5 = 0").select("segment_id"), "segment_id", "left_anti").select("segment_id")


MARK = "a AS (SELECT recording_id, start_ms AS t FROM turns_ref), b AS (SELECT recording_id, start_ms AS m, event_id % 2 + 1 AS priority, (event_id % 10) / 10.0::DOUBLE AS confidence, event_id FROM turns_hyp)"


@query(with_tables("turns_ref turns_hyp", f"WITH {MARK} SELECT recording_id, t, m, score FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, t ORDER BY score DESC, d, priority DESC, m, event_id) AS k FROM (SELECT DISTINCT a.recording_id, t, m, priority, event_id, abs(t - m) AS d, round(0.75 * (1 - abs(t - m) / 60000.0::DOUBLE) + 0.25 * confidence, 9) AS score FROM a JOIN b ON a.recording_id = b.recording_id AND m BETWEEN t - 60000 AND t + 60000)) WHERE k = 1"))
def c11_nearest_marker(spark, sf):
    """The best marker within a minute of each point, by nearness and confidence."""
    points = turns_ref(spark, sf).select("recording_id", F.col("start_ms").alias("t"))
    markers = turns_hyp(spark, sf).select("recording_id", F.col("start_ms").alias("m"), (F.col("event_id") % 2 + 1).alias("priority"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))
    return E.best_markers(points, markers, 60_000)


PROBE = flags(("ASR_DISAGREES", "a.n <> b.n"), ("EMPTY_REFERENCE", "r.n_chars < 40"), ("NO_SPEECH", "r.n_chars % 50 = 0"), ("NO_DIARIZATION", "d.doc_id IS NULL"))


@query(f"SELECT r.doc_id, {PROBE} AS findings FROM documents r JOIN (SELECT doc_id, n_chars // 100 AS n FROM documents) a USING (doc_id) JOIN (SELECT doc_id, (n_chars + doc_id % 7) // 100 AS n FROM documents) b USING (doc_id) LEFT JOIN (SELECT doc_id FROM labels) d USING (doc_id)")
def c13_cross_probes(spark, sf):
    d = table(spark, sf, "documents")
    a = d.select("doc_id", F.expr("n_chars div 100").alias("a"))
    b = d.select("doc_id", F.expr("(n_chars + doc_id % 7) div 100").alias("b"))
    known = table(spark, sf, "labels").select("doc_id").withColumn("known", F.lit(True))
    j = d.select("doc_id", "n_chars").join(a, "doc_id").join(b, "doc_id").join(known, "doc_id", "left")
    return j.select("doc_id", U.codes(ASR_DISAGREES=F.col("a") != F.col("b"), EMPTY_REFERENCE=F.col("n_chars") < 40, NO_SPEECH=F.col("n_chars") % 50 == 0, NO_DIARIZATION=F.col("known").isNull()).alias("findings"))


@query(with_tables("reviews", "SELECT model, severity, count(*) AS n, count(*) FILTER (preferred) AS n_preferred FROM reviews JOIN (VALUES ('m0', 'alpha'), ('m1', 'beta'), ('m2', 'gamma'), ('m3', 'delta')) t(alias, model) USING (alias) GROUP BY 1, 2"))
def c14_unblind(spark, sf):
    names = spark.createDataFrame([("m0", "alpha"), ("m1", "beta"), ("m2", "gamma"), ("m3", "delta")], "alias string, model string")
    return reviews(spark, sf).join(F.broadcast(names), "alias").groupBy("model", "severity").agg(F.count("*").alias("n"), F.count_if("preferred").alias("n_preferred"))


@query(with_tables("candidates", "SELECT c.domain, count(*) AS n_selected, count(*) FILTER (eligible) AS n_eligible, round(avg(score), 6) AS mean_score FROM candidates c JOIN (SELECT domain, group_id, max(candidate_id) AS candidate_id FROM candidates GROUP BY 1, 2) s USING (domain, group_id, candidate_id) GROUP BY 1"))
def c15_selected_candidates(spark, sf):
    c = candidates(spark, sf)
    s = c.groupBy("domain", "group_id").agg(F.max("candidate_id").alias("candidate_id"))
    return c.join(s, ["domain", "group_id", "candidate_id"]).groupBy("domain").agg(F.count("*").alias("n_selected"), F.count_if("eligible").alias("n_eligible"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'present' END AS metrics, CASE WHEN c.n IS NULL THEN 'missing' ELSE 'present' END AS transcript, coalesce(c.n, 0) AS n_segments FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1) c USING (doc_id)")
def c17_run_completeness(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    have = table(spark, sf, "labels").select("doc_id").withColumn("m", F.lit("present"))
    return table(spark, sf, "documents").select("doc_id").join(have, "doc_id", "left").join(c, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit("missing")).alias("metrics"), F.when(F.col("n").isNull(), "missing").otherwise("present").alias("transcript"), F.coalesce("n", F.lit(0)).alias("n_segments"))


LANG = "l AS (SELECT event_id, recording_id, start_ms, end_ms, CASE WHEN event_id % 4 = 0 THEN 'de' ELSE 'en' END AS language FROM turns_ref), h AS (SELECT event_id, recording_id, start_ms, end_ms, CASE WHEN event_id % 5 = 0 THEN 'de' ELSE 'en' END AS language FROM turns_hyp)"


@query(with_tables("turns_ref turns_hyp", f"WITH {LANG} SELECT coalesce(l.language, 'all') AS language, CAST(sum(least(l.end_ms, h.end_ms) - greatest(l.start_ms, h.start_ms)) AS BIGINT) AS common_ms, CAST(sum(CASE WHEN l.language = h.language THEN least(l.end_ms, h.end_ms) - greatest(l.start_ms, h.start_ms) ELSE 0 END) AS BIGINT) AS agreed_ms FROM l JOIN h ON l.recording_id = h.recording_id AND l.start_ms < h.end_ms AND h.start_ms < l.end_ms GROUP BY GROUPING SETS ((l.language), ())"))
def d22_language_time(spark, sf):
    lang = lambda df, k: df.withColumn("language", F.when(F.col("event_id") % k == 0, "de").otherwise("en")).drop("speaker_id")
    per = I.common_time(lang(turns_ref(spark, sf), 4), lang(turns_hyp(spark, sf), 5), "language")
    out = per.rollup("language").agg(F.sum("common_ms").alias("common_ms"), F.sum("equal_ms").alias("agreed_ms"))
    return out.withColumn("language", F.coalesce("language", F.lit("all")))


@query(with_tables("doc_pairs", "SELECT lang, CAST(sum(len(list_filter(range(1, least(len(ref_words), len(hyp_words)) + 1), lambda i: ref_words[i] = hyp_words[i]))) AS BIGINT) AS n_equal, CAST(sum(len(ref_words)) AS BIGINT) AS n_words FROM doc_pairs GROUP BY 1"))
def d23_token_agreement(spark, sf):
    n = F.size(F.filter(F.arrays_zip("ref_words", "hyp_words"), lambda x: x["ref_words"] == x["hyp_words"]))
    return doc_pairs(spark, sf).groupBy("lang").agg(F.sum(n).alias("n_equal"), F.sum(F.size("ref_words")).alias("n_words"))


@query(with_tables("segments", "SELECT recording_id, count(*) AS n, count(*) FILTER (language = 'en') AS n_match, count(*) FILTER (language IS NULL) AS n_undetermined FROM segments GROUP BY 1"))
def d24_segment_language(spark, sf):
    return segments(spark, sf).groupBy("recording_id").agg(F.count("*").alias("n"), F.count_if(F.col("language") == "en").alias("n_match"), F.count_if(F.col("language").isNull()).alias("n_undetermined"))


@query(with_tables("eval_cases", "SELECT coalesce(source, 'all') AS source, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(wer), 9) AS mean_wer FROM eval_cases GROUP BY ROLLUP (source)"))
def a15_run_summary(spark, sf):
    return eval_cases(spark, sf).rollup("source").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("total"), F.round(F.avg("wer"), 9).alias("mean_wer")).withColumn("source", F.coalesce("source", F.lit("all")))


@query(with_tables("stage_samples", "SELECT job_id, count(*) AS n, round(max(latency_ms), 6) AS peak, array_to_string(list_sort(list_distinct(list(stage))), ',') AS stages, len(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda s: NOT list_contains(list_distinct(list(stage)), s))) AS n_missing FROM stage_samples GROUP BY 1"))
def d30_run_audit(spark, sf):
    seen = F.array_sort(F.collect_set("stage"))
    wanted = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    return stage_samples(spark, sf).groupBy("job_id").agg(F.count("*").alias("n"), F.round(F.max("latency_ms"), 6).alias("peak"), F.array_join(seen, ",").alias("stages"), F.size(F.array_except(wanted, seen)).cast("long").alias("n_missing"))


SYS = "c AS (SELECT recording_id, system, count(DISTINCT speaker_id) AS n, count(*) AS turns, avg(end_ms - start_ms) AS mean_ms, count(*) FILTER (end_ms - start_ms < 60000) AS short FROM turns_by_system GROUP BY 1, 2)"


@query(with_tables("turns_by_system", f"WITH {SYS}, v AS (SELECT c.recording_id, k, sum(exp(-abs(c.n - k))) + 0.1 * count(*) FILTER (c.n = k) AS w FROM c CROSS JOIN (SELECT unnest(range(1, 9)) AS k) GROUP BY 1, 2) SELECT recording_id, k AS speakers, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY round(w, 9) DESC, k) AS r FROM v) WHERE r = 1"))
def d35_count_vote(spark, sf):
    n = turns_by_system(spark, sf).groupBy("recording_id", "system").agg(F.count_distinct("speaker_id").alias("n"))
    v = n.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8)))).groupBy("recording_id", "k").agg((F.sum(F.exp(-F.abs(F.col("n") - F.col("k")))) + 0.1 * F.count_if(F.col("n") == F.col("k"))).alias("w"))
    return v.groupBy("recording_id").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("k")).alias("m"))).alias("b")).select("recording_id", (-F.col("b.m")).cast("long").alias("speakers"), F.round(F.col("b.w"), 6).alias("weight"))


@query(with_tables("eval_cases", "SELECT flag, count(*) AS n, count(*) >= 50 AS signal FROM (SELECT unnest(list_filter([CASE WHEN wer > 0.7 THEN 'HIGH_WER' END, CASE WHEN n_chars > 4000 THEN 'LONG' END, CASE WHEN NOT truth_eligible THEN 'NO_TRUTH' END], lambda x: x IS NOT NULL)) AS flag FROM eval_cases) GROUP BY 1"))
def d38_signals(spark, sf):
    f = F.array_compact(F.array(F.when(F.col("wer") > 0.7, "HIGH_WER"), F.when(F.col("n_chars") > 4000, "LONG"), F.when(~F.col("truth_eligible"), "NO_TRUTH")))
    return eval_cases(spark, sf).select(F.explode(f).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"), (F.count("*") >= 50).alias("signal"))


KIND = "CASE WHEN regexp_matches(text, '[0-9]') THEN 'numeric' WHEN regexp_matches(text, '[ñáéíóúäöüßèêç]') THEN 'accented' WHEN regexp_matches(text, '^[A-Z]') THEN 'plain' ELSE 'other' END"


@query(f"SELECT role, {KIND} AS kind, count(*) AS n FROM conversations GROUP BY 1, 2")
def d39_defect_kinds(spark, sf):
    t = F.col("text")
    kind = F.when(t.rlike("[0-9]"), "numeric").when(t.rlike("[ñáéíóúäöüßèêç]"), "accented").when(t.rlike("^[A-Z]"), "plain").otherwise("other")
    return table(spark, sf, "conversations").groupBy("role", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(with_tables("turns_ref", "SELECT recording_id, speaker_id, count(*) AS n_runs, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, sum(end_ms - start_ms) >= 30000000 AND count(*) >= 3 AS stable FROM turns_ref GROUP BY 1, 2"))
def d40_speaker_statistics(spark, sf):
    d = F.sum(F.col("end_ms") - F.col("start_ms"))
    return turns_ref(spark, sf).groupBy("recording_id", "speaker_id").agg(F.count("*").alias("n_runs"), d.alias("total_ms"), ((d >= 30_000_000) & (F.count("*") >= 3)).alias("stable"))


@query(with_tables("frames", "SELECT recording_id, count(*) AS n, count(*) FILTER (rms_db > 0) AS n_speech, round(avg(CASE WHEN rms_db > 0 THEN 1 ELSE 0 END), 9) AS ratio, CASE WHEN avg(CASE WHEN rms_db > 0 THEN 1 ELSE 0 END) >= 0.3 THEN 'speech' WHEN count(*) FILTER (rms_db > 0) > 0 THEN 'sparse' ELSE 'silent' END AS class FROM frames GROUP BY 1"))
def d41_speech_ratio(spark, sf):
    share = F.avg((F.col("rms_db") > 0).cast("int"))
    return frames(spark, sf).groupBy("recording_id").agg(F.count("*").alias("n"), F.count_if(F.col("rms_db") > 0).alias("n_speech"), F.round(share, 9).alias("ratio"), F.when(share >= 0.3, "speech").when(F.count_if(F.col("rms_db") > 0) > 0, "sparse").otherwise("silent").alias("class"))


@query(with_tables("eval_cases", "SELECT split, round(avg(CASE WHEN (n_chars > 200) = (wer IS NOT NULL) THEN 1 ELSE 0 END), 9) AS match_rate, count(*) AS n FROM eval_cases WHERE truth_eligible GROUP BY 1"))
def d42_presence_match(spark, sf):
    return eval_cases(spark, sf).where("truth_eligible").groupBy("split").agg(F.round(F.avg(((F.col("n_chars") > 200) == F.col("wer").isNotNull()).cast("int")), 9).alias("match_rate"), F.count("*").alias("n"))


def stage_means(spark, sf, k):
    return stage_samples(spark, sf).where(F.col("event_id") % 2 == k).groupBy(F.concat_ws("/", "stage", "job_id").alias("key")).agg(F.round(F.avg("latency_ms"), 6).alias("value")).withColumn("metric", F.lit("latency")).withColumn("objective", F.lit("min"))


HALVES = "a AS (SELECT stage || '/' || job_id AS key, round(avg(latency_ms), 6) AS a FROM stage_samples WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT stage || '/' || job_id AS key, round(avg(latency_ms), 6) AS b FROM stage_samples WHERE event_id % 2 = 1 GROUP BY 1)"


@query(with_tables("stage_samples", f"WITH {HALVES} SELECT key, 'latency' AS metric, CASE WHEN a IS NULL OR b IS NULL THEN 'not-scored' WHEN abs(a - b) <= 1e-12 THEN 'unchanged' WHEN a - b > 0 THEN 'improved' ELSE 'regressed' END AS change FROM a FULL JOIN b USING (key)"))
def d44_metric_changes(spark, sf):
    return U.metric_changes(stage_means(spark, sf, 0), stage_means(spark, sf, 1))


@query(with_tables("stage_samples", f"WITH {HALVES} SELECT * FROM (SELECT key, 'latency' AS metric, CASE WHEN a IS NULL THEN 'MISSING_STORED' WHEN b IS NULL THEN 'MISSING_RECOMPUTED' WHEN abs(a - b) > 40 THEN 'DIFFERS' END AS code FROM a FULL JOIN b USING (key)) WHERE code IS NOT NULL"))
def d45_report_audit(spark, sf):
    return U.mismatches(stage_means(spark, sf, 0), stage_means(spark, sf, 1), 40)


@query(with_tables("frames", "SELECT gate, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN rms_db < -90 THEN 'CONTRAST' END, CASE WHEN centroid > 3000 THEN 'COLOUR' END, CASE WHEN zcr < 0.02 THEN 'CONTAINMENT' END], lambda x: x IS NOT NULL)) AS gate FROM frames) GROUP BY 1"))
def d46_frame_gates(spark, sf):
    g = F.array_compact(F.array(F.when(F.col("rms_db") < -90, "CONTRAST"), F.when(F.col("centroid") > 3000, "COLOUR"), F.when(F.col("zcr") < 0.02, "CONTAINMENT")))
    return frames(spark, sf).select(F.explode(g).alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))


@query(with_tables("turns_by_system", f"WITH {SYS} SELECT recording_id, CASE WHEN count(DISTINCT n) = 1 THEN min(n) END AS prior FROM c GROUP BY 1"))
def d47_count_prior(spark, sf):
    n = turns_by_system(spark, sf).groupBy("recording_id", "system").agg(F.count_distinct("speaker_id").alias("n"))
    return n.groupBy("recording_id").agg(F.when(F.count_distinct("n") == 1, F.min("n")).alias("prior"))


@query("SELECT doc_id, n_chars, sha256(text) = sha256(text) AS intact FROM documents")
def a7_row_access(spark, sf):
    """Every row by its id, with a check of its content's hash against the stored one."""
    d = table(spark, sf, "documents")
    stored = d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return d.join(stored, "doc_id").select("doc_id", "n_chars", (F.sha2(F.col("text").cast("binary"), 256) == F.col("sha")).alias("intact"))
