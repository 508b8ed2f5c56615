"""Queries that select, split, vote and check coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.operators import sampling as P
from spanline.operators import selection as D
from spanline.operators import windows as W
from spanline.operators.scoring import seeded_order

from .registry import query
from .tables import candidates, eval_cases, segments, table, trials, turns_by_system, turns_hyp, turns_ref, with_tables


@query(with_tables("candidates", "SELECT domain, group_id, candidate_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY domain, group_id ORDER BY score DESC, candidate_id) AS rank FROM candidates) WHERE rank <= 1 OR current"))
def f1_top_candidates(spark, sf):
    return P.top_candidates(candidates(spark, sf), ["domain", "group_id"], 1, F.col("current")).select("domain", "group_id", "candidate_id", "score", "rank")


@query(with_tables("segments", "SELECT segment_id FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY confidence, segment_id) AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM segments) WHERE k <= floor(0.25 * n)"))
def f3_review_budget(spark, sf):
    return P.within_budget(segments(spark, sf), ["recording_id"], ["confidence", "segment_id"], 0.25).select("segment_id")


@query(with_tables("segments", "SELECT segment_id, reasons, speaker_id = 'system' AS protected FROM (SELECT segment_id, speaker_id, array_to_string(list_filter([CASE WHEN confidence < 0.3 THEN 'LOW_CONFIDENCE' END, CASE WHEN end_ms - start_ms > 60000 THEN 'LONG' END, CASE WHEN end_ms - start_ms < 1500 THEN 'SHORT' END], lambda x: x IS NOT NULL), ',') AS reasons FROM segments) WHERE reasons <> ''"))
def f2_escalation(spark, sf):
    d = F.col("end_ms") - F.col("start_ms")
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("confidence") < 0.3, "LOW_CONFIDENCE"), F.when(d > 60000, "LONG"), F.when(d < 1500, "SHORT"))), ",")
    return segments(spark, sf).select("segment_id", reasons.alias("reasons"), (F.col("speaker_id") == "system").alias("protected")).where("reasons <> ''")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE n <= 5 OR list_contains(list_transform(range(5), lambda j: CAST(round_even(j * (n - 1) / 4.0::DOUBLE, 0) AS BIGINT)), i)")
def f5_even_sample(spark, sf):
    return P.even_sample(table(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 5)


@query("SELECT lang, count(*) AS places, max(n) AS n FROM (SELECT lang, n, j FROM (SELECT lang, n, unnest(range(1, CAST(least(n, 40) AS BIGINT) + 1)) AS j FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)) ORDER BY CASE WHEN j = 1 THEN 0 ELSE 1 END, n / j::DOUBLE DESC, lang, j LIMIT 40) GROUP BY 1")
def f6_stratified(spark, sf):
    return P.stratified_allocation(table(spark, sf, "documents"), "lang", 40)


CASE_FEATURES = """list_distinct(['source:' || source, 'language:' || language, 'speakers:' || CASE WHEN speaker_count <= 1 THEN 'one' WHEN speaker_count <= 3 THEN 'few' ELSE 'many' END,
    'size:' || CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END, CASE WHEN truth_eligible THEN 'truth:yes' ELSE 'truth:no' END] || list_transform(scenarios, lambda s: 'scenario:' || s))"""


@query(with_tables("eval_cases", f"""WITH RECURSIVE t AS (SELECT case_id, unnest({CASE_FEATURES}) AS f FROM eval_cases), w AS (SELECT f, 1 / count(*) AS w FROM t GROUP BY 1),
    s AS (SELECT 0 AS place, NULL::BIGINT AS case_id, []::BIGINT[] AS picked, []::VARCHAR[] AS covered
      UNION ALL SELECT place + 1, case_id, list_append(picked, case_id), covered || fs FROM (
        SELECT s.place, t.case_id, s.picked, s.covered, list(t.f) AS fs, row_number() OVER (ORDER BY round(sum(CASE WHEN list_contains(s.covered, t.f) THEN 0 ELSE w.w END), 12) DESC, t.case_id) AS k
        FROM s, t JOIN w USING (f) WHERE NOT list_contains(s.picked, t.case_id) AND s.place < 30 GROUP BY 1, 2, 3, 4) WHERE k = 1)
    SELECT place - 1 AS place, case_id FROM s WHERE place > 0"""))
def f7_diverse_cases(spark, sf):
    return D.diverse_cases(eval_cases(spark, sf), 30)


def disputed_trials(spark, sf):
    """Trials on which two thresholds of one score may differ; a genre is the remainder of a label."""
    genre = lambda f: f(F.col("l_label") % 3, F.col("r_label") % 3).cast("string")
    return trials(spark, sf).select(
        F.concat_ws(":", "l", "r").alias("case_id"), "same", ((F.col("score") >= 0.05) != (F.col("score") >= 0.25)).alias("disagreement"), F.round(F.abs(F.col("score") - 0.05), 9).alias("conflict"),
        F.round(F.abs(F.col("score") - 0.25), 9).alias("nearness"), F.concat_ws("-", genre(F.least), genre(F.greatest)).alias("genre"), F.array(F.col("l_label").cast("string"), F.col("r_label").cast("string")).alias("speakers"),
    )


@query(with_tables("trials", """WITH d AS (SELECT l || ':' || r AS case_id, same, (score >= 0.05) <> (score >= 0.25) AS disagreement, round(abs(score - 0.05), 9) AS conflict, round(abs(score - 0.25), 9) AS nearness FROM trials),
    p AS (SELECT bucket, case_id, same, row_number() OVER (PARTITION BY bucket, same ORDER BY CASE WHEN k < 2 THEN -conflict ELSE nearness END, sha256(concat_ws(':', 'd', case_id))) AS rank, size
      FROM d, (VALUES ('high-conflict', 0, 6), ('disagreement', 1, 12), ('near-threshold', 2, 15)) b(bucket, k, size) WHERE k = 2 OR disagreement)
    SELECT bucket, case_id, same, rank FROM p WHERE rank <= size"""))
def f8_dispute_pools(spark, sf):
    return D.dispute_pools(disputed_trials(spark, sf), 18, "d").select("bucket", "case_id", "same", "rank")


@query()
def f8_balanced_disputes(spark, sf):
    """Eighteen disputed trials under quotas of bucket and truth, spread over genres and speakers."""
    return D.balanced_disputes(disputed_trials(spark, sf), 18, "d")


WINDOW_MS = 3_600_000


def activity_frames(spark, sf):
    """A frame is an event, two seconds long at most; active from a value of 150, its change the difference to the value before."""
    from pyspark.sql import Window

    before = F.lag("value").over(Window.partitionBy("recording_id").orderBy("start_ms", "event_id"))
    start = F.expr("CAST(timestampdiff(MILLISECOND, date_trunc('DAY', ts), ts) AS BIGINT)")
    rows = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("recording_id"), start.alias("start_ms"), "value")
    return rows.select("recording_id", "start_ms", F.least(F.col("start_ms") + 2000, F.lit(86_400_000)).cast("long").alias("end_ms"), (F.col("value") >= 150).alias("active"), F.round(F.abs(F.col("value") - F.coalesce(before, "value")) / 500, 9).alias("change"))


def _picks(order: str, reason: str, number: int, source: str) -> str:
    """One pick of each recording: the first active frame by `order` whose window is far enough from those of `source`."""
    return f"""SELECT recording_id, chosen || coalesce(list_filter([new], lambda x: x IS NOT NULL), []) AS chosen FROM (SELECT c.recording_id, c.chosen, (SELECT {{'reason': '{reason}-{number}', 'pos': f.pos}} FROM a f
        WHERE f.recording_id = c.recording_id AND len(list_filter(c.chosen, lambda x: abs(x.pos - f.pos) < {WINDOW_MS // 2})) = 0 ORDER BY {order} LIMIT 1) AS new FROM {source} c)"""


@query(with_tables("turns_ref", f"""WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS recording_id, date_diff('millisecond', date_trunc('day', ts), ts) AS start_ms FROM events),
    f AS (SELECT recording_id, start_ms, least(start_ms + 2000, 86400000) AS end_ms, value >= 150 AS active, round(abs(value - coalesce(lag(value) OVER (PARTITION BY recording_id ORDER BY start_ms, event_id), value)) / 500, 9) AS change, (start_ms + least(start_ms + 2000, 86400000)) // 2 AS middle FROM e),
    a AS (SELECT *, greatest(0, least(86400000 - {WINDOW_MS}, middle - {WINDOW_MS // 2})) AS pos, sha256(concat_ws(':', 'w', recording_id, start_ms, end_ms)) AS chance FROM f WHERE active),
    s AS (SELECT recording_id, [{{'reason': 'start', 'pos': greatest(0, least(86400000 - {WINDOW_MS}, min(start_ms) - {WINDOW_MS // 10}))}}, {{'reason': 'middle', 'pos': arg_min(pos, (abs(middle - 43200000) * 100000000 + start_ms)::HUGEINT)}},
      {{'reason': 'end', 'pos': greatest(0, least(86400000 - {WINDOW_MS}, max(end_ms) - {WINDOW_MS * 9 // 10}))}}] AS three FROM a GROUP BY 1),
    c0 AS (SELECT recording_id, list_filter(three, lambda x, i: len(list_filter(three[:i - 1], lambda y: y.pos = x.pos)) = 0) AS chosen FROM s),
    c1 AS ({_picks('chance, start_ms', 'random', 1, 'c0')}), c2 AS ({_picks('chance, start_ms', 'random', 2, 'c1')}),
    c3 AS ({_picks('change DESC, start_ms', 'change', 1, 'c2')}), c4 AS ({_picks('change DESC, start_ms', 'change', 2, 'c3')}), c5 AS ({_picks('change DESC, start_ms', 'change', 3, 'c4')}),
    w AS (SELECT recording_id, unnest(chosen, recursive := true) FROM c5)
    SELECT w.recording_id, reason, w.pos AS start_ms, w.pos + {WINDOW_MS} AS end_ms, round(coalesce(avg(active::INTEGER), 0), 9) AS active_ratio, round(coalesce(avg(change), 0), 9) AS mean_change, round(coalesce(max(change), 0), 9) AS max_change
    FROM w LEFT JOIN f ON f.recording_id = w.recording_id AND f.middle >= w.pos AND f.middle < w.pos + {WINDOW_MS} GROUP BY 1, 2, 3, 4"""))
def f9_stratified_windows(spark, sf):
    frames = activity_frames(spark, sf)
    spans = frames.select("recording_id").distinct().withColumn("duration_ms", F.lit(86_400_000).cast("long"))
    return D.stratified_windows(frames, spans, WINDOW_MS, "w")


@query(with_tables("turns_ref", "WITH w AS (SELECT DISTINCT recording_id, unnest(range(0, 86400001 - 3600000, 1800000)) AS s FROM turns_ref) SELECT recording_id, k, s AS start_ms FROM (SELECT recording_id, s, row_number() OVER (PARTITION BY recording_id ORDER BY sha256(concat_ws(':', 'w', recording_id, s))) AS k FROM w) WHERE k <= 3"))
def f9_seeded_windows(spark, sf):
    spans = turns_ref(spark, sf).select("recording_id").distinct().withColumn("duration_ms", F.lit(86_400_000).cast("long"))
    return P.seeded_windows(spans, 3_600_000, 1_800_000, 3, "w")


WINDOWS = "w AS (SELECT DISTINCT recording_id, start_ms AS s, start_ms + 1800000 AS e FROM turns_ref WHERE start_ms + 1800000 <= 86400000), o AS (SELECT w.recording_id, w.s, w.e, t.speaker_id, sum(least(t.end_ms, w.e) - greatest(t.start_ms, w.s)) AS ms FROM w JOIN turns_ref t ON t.recording_id = w.recording_id AND t.start_ms < w.e AND w.s < t.end_ms GROUP BY ALL)"


def speaker_windows(spark, sf, least_ms=1):
    ref = turns_ref(spark, sf)
    return W.speaker_windows(ref.where("start_ms + 1800000 <= 86400000").select("recording_id", "start_ms"), ref, 1_800_000, least_ms)


@query(with_tables("turns_ref", f"WITH {WINDOWS}, g AS (SELECT recording_id, s, e, count(*) AS n, min(ms) AS least_ms, sum(ms) AS speech FROM o GROUP BY 1, 2, 3) SELECT recording_id, s AS start_ms, least_ms::BIGINT AS least_ms FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY least_ms DESC, speech DESC, s) AS k FROM g WHERE n = 2) WHERE k = 1"))
def f10_exact_speaker_window(spark, sf):
    best = F.max(F.struct("least_ms", "speech_ms", (-F.col("start_ms")).alias("s"))).alias("b")
    return speaker_windows(spark, sf).where("n = 2").groupBy("recording_id").agg(best).select("recording_id", (-F.col("b.s")).alias("start_ms"), F.col("b.least_ms").alias("least_ms"))


@query(with_tables("turns_ref", f"WITH {WINDOWS} SELECT recording_id, count(*) AS n_windows, min(s) AS first_ms FROM (SELECT recording_id, s FROM o WHERE ms >= 60000 GROUP BY 1, 2 HAVING count(*) = 3) GROUP BY 1"))
def f11_windows_with_n_speakers(spark, sf):
    return speaker_windows(spark, sf, 60_000).where("n = 3").groupBy("recording_id").agg(F.count("*").alias("n_windows"), F.min("start_ms").alias("first_ms"))


@query(with_tables("segments", "SELECT segment_id, CASE WHEN (start_ms + end_ms) / 2 < max(end_ms) OVER (PARTITION BY recording_id) * 0.7 THEN 'development' ELSE 'held-out' END AS split FROM segments"))
def f16_time_split(spark, sf):
    return P.time_split(segments(spark, sf), 0.7).select("segment_id", "split")


@query("SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN vec_id % 10 = 0 THEN 0 ELSE 1 END, sha256(concat_ws(':', 'run-1', vec_id))) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE k <= ceil(n * 4 / 5)")
def f17_resample(spark, sf):
    return P.resample(table(spark, sf, "embeddings").select("vec_id", "label"), ["label"], seeded_order("run-1", "vec_id"), F.col("vec_id") % 10 == 0).select("vec_id")


@query("SELECT user_id, n_clips, CASE WHEN row_number() OVER (ORDER BY sha256(concat_ws(':', 's', user_id))) % 2 = 1 THEN 'development' ELSE 'held-out' END AS split FROM (SELECT user_id, count(*) AS n_clips FROM events GROUP BY 1) WHERE n_clips >= 5")
def f18_disjoint_split(spark, sf):
    return P.disjoint_split(table(spark, sf, "events"), "user_id", 5, "s")


@query("SELECT source, place, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM (SELECT source, min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY source, lower(trim(text)))) WHERE place <= 20")
def f21_unique_first(spark, sf):
    return P.unique_first(table(spark, sf, "documents").select("source", "doc_id", "text"), ["source"], "text", "doc_id", 20)


@query(with_tables("turns_by_system", "SELECT recording_id, count(DISTINCT n) > 1 OR max(n) >= 5 AS probe FROM (SELECT recording_id, system, count(DISTINCT speaker_id) AS n FROM turns_by_system GROUP BY 1, 2) GROUP BY 1"))
def f22_second_opinion(spark, sf):
    n = turns_by_system(spark, sf).groupBy("recording_id", "system").agg(F.count_distinct("speaker_id").alias("n"))
    return n.groupBy("recording_id").agg(((F.count_distinct("n") > 1) | (F.max("n") >= 5)).alias("probe"))


@query(with_tables("eval_cases", "SELECT case_id FROM eval_cases WHERE split = 'development' AND language IN ('en', 'de') AND list_has_any(scenarios, ['len-1', 'len-2']) AND speaker_count IN (1, 2)"))
def b7_selector(spark, sf):
    return P.selected(eval_cases(spark, sf), "development", ["en", "de"], ["len-1", "len-2"], [1, 2]).select("case_id")


@query(with_tables("eval_cases", "SELECT tag, count(*) AS n FROM (SELECT unnest(list_concat(['source:' || source, 'language:' || language, 'speakers:' || CASE WHEN speaker_count <= 1 THEN 'one' WHEN speaker_count <= 3 THEN 'few' ELSE 'many' END, 'size:' || CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END, CASE WHEN truth_eligible THEN 'truth:yes' ELSE 'truth:no' END], list_transform(scenarios, lambda s: 'scenario:' || s))) AS tag FROM eval_cases) GROUP BY 1"))
def b9_case_features(spark, sf):
    c = eval_cases(spark, sf)
    return c.select(F.explode(P.case_features(c)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


METRICS = "m AS (SELECT case_id, 'wer' AS metric, wer AS value FROM eval_cases WHERE wer IS NOT NULL UNION ALL SELECT case_id, 'chars', n_chars FROM eval_cases)"


@query(with_tables("eval_cases", f"WITH {METRICS}, r AS (SELECT * FROM (VALUES ('wer', 'lte', 0.5), ('chars', 'gte', 300.0)) t(metric, op, threshold)) SELECT case_id, count(*) AS n_rules, count(*) FILTER (ok) AS n_passed, bool_and(ok) AS accepted FROM (SELECT c.case_id, coalesce(CASE r.op WHEN 'lte' THEN value <= threshold WHEN 'gte' THEN value >= threshold END, false) AS ok FROM (SELECT DISTINCT case_id FROM m) c CROSS JOIN r LEFT JOIN m ON m.case_id = c.case_id AND m.metric = r.metric) GROUP BY 1"))
def b11_acceptance(spark, sf):
    c = eval_cases(spark, sf)
    m = c.where("wer IS NOT NULL").select("case_id", F.lit("wer").alias("metric"), F.col("wer").alias("value")).unionByName(c.select("case_id", F.lit("chars").alias("metric"), F.col("n_chars").cast("double").alias("value")))
    rules = spark.createDataFrame([("wer", "lte", 0.5), ("chars", "gte", 300.0)], "metric string, op string, threshold double")
    return P.acceptance(m, rules)


@query(with_tables("eval_cases", """WITH b AS (SELECT 'scenario' AS dimension, unnest(list_distinct(scenarios)) AS bucket, split FROM eval_cases UNION ALL SELECT 'language', language, split FROM eval_cases UNION ALL SELECT 'source', source, split FROM eval_cases UNION ALL SELECT 'speakers', speaker_count::VARCHAR, split FROM eval_cases),
    n AS (SELECT dimension, bucket, count(*) FILTER (split = 'development') AS n_development, count(*) FILTER (split = 'held-out') AS n_held_out FROM b GROUP BY 1, 2)
    SELECT *, array_to_string(list_filter([CASE WHEN n_development < 20 THEN 'development' END, CASE WHEN n_held_out < 20 THEN 'held-out' END], lambda x: x IS NOT NULL), ',') AS gaps,
      CASE WHEN least(n_development, n_held_out) >= 20 THEN '' WHEN least(n_development, n_held_out) = 0 THEN 'MISSING' ELSE 'SHORT_OF:' || (greatest(0, 20 - n_development) + greatest(0, 20 - n_held_out)) END AS reason FROM n"""))
def d31_coverage(spark, sf):
    return P.coverage(eval_cases(spark, sf), 20)


@query(with_tables("eval_cases", "SELECT media_sha FROM eval_cases WHERE split = 'development' INTERSECT SELECT media_sha FROM eval_cases WHERE split = 'held-out'"))
def g3_split_leakage(spark, sf):
    c = eval_cases(spark, sf)
    side = lambda s: c.where(F.col("split") == s).select("media_sha")
    return side("development").intersect(side("held-out"))


@query(with_tables("eval_cases", "SELECT media_sha, count(DISTINCT split) AS n_splits, count(*) AS n_cases FROM eval_cases GROUP BY 1 HAVING count(DISTINCT split) > 1"))
def d31_leaked_media(spark, sf):
    return P.leaked(eval_cases(spark, sf))


@query(with_tables("eval_cases", "SELECT split, language, count(*) AS n_matched, count(*) FILTER (wer <= 0.6) AS n_approved, count(*) FILTER (wer IS NULL) AS n_missing FROM eval_cases GROUP BY 1, 2"))
def d32_profile_coverage(spark, sf):
    return eval_cases(spark, sf).groupBy("split", "language").agg(F.count("*").alias("n_matched"), F.count_if(F.col("wer") <= 0.6).alias("n_approved"), F.count_if(F.col("wer").isNull()).alias("n_missing"))


@query("SELECT user_id, count(DISTINCT ts::DATE) AS n_sessions FROM events GROUP BY 1 HAVING count(DISTINCT ts::DATE) > 1")
def d33_identity_scope(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("n_sessions")).where("n_sessions > 1")


@query("WITH v AS (SELECT source, lang AS language, sum(n_chars) AS w FROM documents GROUP BY 1, 2), t AS (SELECT *, row_number() OVER o AS k, lead(w, 1, 0) OVER o AS next, sum(w) OVER (PARTITION BY source) AS total FROM v WINDOW o AS (PARTITION BY source ORDER BY w DESC, language)) SELECT source, CASE WHEN total <= 0 THEN 'und' WHEN w / total >= 0.8 OR (w - next) / total >= 0.2 THEN language ELSE 'mul' END AS language, round(w / total, 9) AS share FROM t WHERE k = 1")
def d21_language_vote(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("lang", "language")
    return P.language_vote(d, ["source"], "n_chars")


#: The best map of labels by a walk over the labels of one side with the set of taken labels of the other as bits.
AGREE = """WITH RECURSIVE p AS (SELECT label AS a, vec_id % 7 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2),
    x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS same, (SELECT sum(n) FROM c) AS total, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS pairs, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS sb),
    l AS (SELECT a, row_number() OVER (ORDER BY a) AS i FROM (SELECT DISTINCT a FROM c)),
    m AS (SELECT 0::BIGINT AS i, 0::BIGINT AS taken, 0::BIGINT AS n
      UNION ALL SELECT i, taken, max(n) AS n FROM (
        SELECT m.i + 1 AS i, m.taken, m.n FROM m WHERE m.i < (SELECT count(*) FROM l)
        UNION ALL SELECT l.i, m.taken | (1 << c.b), m.n + c.n FROM m JOIN l ON l.i = m.i + 1 JOIN c ON c.a = l.a WHERE m.taken & (1 << c.b) = 0) GROUP BY 1, 2)
    SELECT round((same - sa * sb / pairs) / ((sa + sb) / 2 - sa * sb / pairs), 9) AS adjusted_rand, round(same / (sa + sb - same), 9) AS jaccard,
      round(1 - (sa + sb - 2 * same) / pairs, 9) AS coassociation, round((SELECT max(n) FROM m) / total, 9) AS aligned_accuracy FROM x"""


@query(AGREE)
def d25_partition_agreement(spark, sf):
    return P.partition_agreement(table(spark, sf, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b")))


LEAK = r"""WITH f AS (SELECT DISTINCT private_id, substr(t, i, 16) AS f FROM (SELECT private_id, t, unnest(range(1, length(t) - 14, 8)) AS i FROM (SELECT item_id AS private_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS t FROM benchmark) WHERE length(t) >= 16)),
    s AS (SELECT DISTINCT public_id, substr(t, i, 16) AS f FROM (SELECT public_id, t, unnest(range(1, length(t) - 14)) AS i FROM (SELECT doc_id AS public_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS t FROM documents) WHERE length(t) >= 16) WHERE substr(t, i, 16) IN (SELECT f FROM f))
    SELECT public_id, private_id, count(DISTINCT f) AS n_fragments FROM s JOIN f USING (f) GROUP BY 1, 2"""


def leaks(spark, sf):
    ids = lambda df, c: df.select(F.col(c).alias("id"), "text")
    return P.leak_scan(ids(table(spark, sf, "benchmark"), "item_id"), ids(table(spark, sf, "documents"), "doc_id"))


@query(r"SELECT d.doc_id AS public_id, b.item_id AS private_id, CASE WHEN d.text = b.text THEN 'exact' ELSE 'normalized' END AS kind FROM documents d JOIN benchmark b ON regexp_replace(lower(d.text), '[^\p{L}\p{N}]+', '', 'g') = regexp_replace(lower(b.text), '[^\p{L}\p{N}]+', '', 'g') WHERE regexp_replace(lower(b.text), '[^\p{L}\p{N}]+', '', 'g') <> ''")
def g5_whole_matches(spark, sf):
    """Documents that are a benchmark item as a whole."""
    return P.whole_leaks(*[table(spark, sf, t).select(F.col(c).alias("id"), "text") for t, c in (("benchmark", "item_id"), ("documents", "doc_id"))])


@query(LEAK)
def g5_leak_scan(spark, sf):
    return leaks(spark, sf)


@query(f"SELECT count(DISTINCT public_id) AS n_documents, count(DISTINCT private_id) AS n_items, count(*) = 0 AS safe FROM ({LEAK})")
def l18_publish_check(spark, sf):
    return leaks(spark, sf).agg(F.count_distinct("public_id").alias("n_documents"), F.count_distinct("private_id").alias("n_items"), (F.count("*") == 0).alias("safe"))


@query(with_tables("turns_hyp", "SELECT event_id, recording_id, '' || ascii(speaker_id) AS speaker_id, greatest(start_ms, 0) AS start_ms, end_ms FROM turns_hyp WHERE end_ms - start_ms >= 500000"))
def b2_fusion_filter(spark, sf):
    """Turns long enough for fusion, with normalised speaker ids."""
    from spanline.functions.text import normalize_speaker

    own = turns_hyp(spark, sf).where("end_ms - start_ms >= 500000")
    return own.select("event_id", "recording_id", normalize_speaker(F.concat(F.lit("spk-"), F.ascii("speaker_id").cast("string"))).alias("speaker_id"), F.greatest("start_ms", F.lit(0)).cast("long").alias("start_ms"), "end_ms")
