"""Queries on verification trials, labels and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.functions import vectors as V
from spanline.operators import scoring as S

from .registry import query
from .tables import eval_cases, stage_samples, table, trials, with_tables


@query("SELECT coalesce(event_type, 'unknown') AS value, count(*) AS n FROM events GROUP BY 1")
def d9_value_counts(spark, sf):
    return S.value_counts(table(spark, sf, "events"), "event_type")


@query(with_tables("eval_cases", "SELECT bucket, count(*) AS n_cases, count(wer) AS n_scored, round(avg(wer), 9) AS mean, round(avg(CASE WHEN truth_eligible THEN 1 ELSE 0 END), 9) AS eligible_rate FROM (SELECT unnest(scenarios) AS bucket, wer, truth_eligible FROM eval_cases) GROUP BY 1"))
def d10_bucket_summary(spark, sf):
    return S.bucket_summary(eval_cases(spark, sf), "scenarios", "wer", "truth_eligible")


BINARY = "*, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 9) AS f1"


@query(f"SELECT {BINARY} FROM (SELECT lang, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM (SELECT lang, quality = 1 AS t, n_chars > 1500 AS p FROM labels JOIN documents USING (doc_id)) GROUP BY 1)")
def d11_binary_metrics(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return S.binary_metrics(j, F.col("quality") == 1, F.col("n_chars") > 1500, ["lang"])


@query(with_tables("eval_cases", "SELECT coalesce(split, 'all') AS split, coalesce(language, 'all') AS language, count(*) AS n, round(avg(CASE WHEN truth_eligible THEN 1 ELSE 0 END), 9) AS rate, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM eval_cases GROUP BY CUBE (split, language)"))
def d12_rate_cube(spark, sf):
    return S.rate_cube(eval_cases(spark, sf), ["split", "language"], "truth_eligible", "n_chars")


@query("WITH c AS (SELECT conv_id, turn, list_filter([CASE WHEN length(text) < 40 THEN 'SHORT' END, CASE WHEN contains(text, chr(10)) THEN 'MULTILINE' END, CASE WHEN NOT regexp_matches(text, '[.]$') THEN 'NO_STOP' END], lambda x: x IS NOT NULL) AS codes FROM conversations) SELECT code, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM c), 9) AS rate FROM (SELECT unnest(codes) AS code FROM c) GROUP BY 1")
def d13_failure_modes(spark, sf):
    c = table(spark, sf, "conversations")
    codes = F.array_compact(F.array(F.when(F.length("text") < 40, "SHORT"), F.when(F.col("text").contains("\n"), "MULTILINE"), F.when(~F.col("text").rlike(r"[.]$"), "NO_STOP")))
    return S.failure_modes(c.select("conv_id", "turn", codes.alias("codes")), "codes")


FIXED = "SELECT *, round(1 - (far + frr) / 2, 9) AS balanced_accuracy FROM (SELECT {k} count(*) FILTER (same) AS n_genuine, count(*) FILTER (NOT same) AS n_impostor, round(avg(CASE WHEN score >= 0.2 THEN 1 ELSE 0 END) FILTER (NOT same), 9) AS far, round(avg(CASE WHEN score < 0.2 THEN 1 ELSE 0 END) FILTER (same), 9) AS frr FROM trials {g})"


@query(with_tables("trials", FIXED.format(k="", g="")))
def d14_fixed_threshold(spark, sf):
    return S.fixed_threshold(trials(spark, sf), 0.2)


@query(with_tables("trials", FIXED.format(k="l_label,", g="GROUP BY l_label")))
def d19_bucket_threshold(spark, sf):
    return S.fixed_threshold(trials(spark, sf), 0.2, ["l_label"])


CURVE = "c AS (SELECT score, pos, neg, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb FROM (SELECT score, count(*) FILTER (same) AS pos, count(*) FILTER (NOT same) AS neg FROM trials GROUP BY 1) WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(with_tables("trials", f"WITH {CURVE} SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM c"))
def d15_roc_auc(spark, sf):
    return S.roc_auc(trials(spark, sf))


@query(with_tables("trials", f"WITH {CURVE}, n AS (SELECT sum(pos) AS p, sum(neg) AS n, max(score) AS top FROM c), o AS (SELECT score AS t, 1 - nb / n AS far, pb / p AS frr FROM c, n UNION ALL SELECT top + 1e-12, 0, 1 FROM n), x AS (SELECT round(abs(far - frr), 12) AS gap, round(far + frr, 12) AS s, t, round(0.99 * far + 0.01 * frr, 12) AS dcf FROM o) SELECT (SELECT round(s / 2, 9) FROM x ORDER BY gap, s, t LIMIT 1) AS eer, (SELECT round(min(dcf), 9) FROM x) AS min_dcf"))
def d16_eer_min_dcf(spark, sf):
    return S.eer_and_min_dcf(trials(spark, sf))


P = "(score + 1) / 2"


@query(with_tables("trials", f"SELECT b AS bin, coalesce(n, 0) AS n, mean_p, share FROM (SELECT unnest(range(10)) AS b) LEFT JOIN (SELECT CAST(least(floor({P} * 10), 9) AS BIGINT) AS b, count(*) AS n, round(avg({P}), 9) AS mean_p, round(avg(CASE WHEN same THEN 1 ELSE 0 END), 9) AS share FROM trials GROUP BY 1) USING (b)"))
def d17_calibration_bins(spark, sf):
    return S.calibration(trials(spark, sf), (F.col("score") + 1) / 2, F.col("same"))


@query(with_tables("trials", f"WITH b AS (SELECT {P} AS p, CASE WHEN same THEN 1 ELSE 0 END AS y, least(greatest({P}, 1e-15), 1 - 1e-15) AS q FROM trials), g AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, abs(sum(p) - sum(y)) AS gap, sum((p - y) * (p - y)) AS b, sum(-(y * ln(q) + (1 - y) * ln(1 - q))) AS l FROM b GROUP BY 1) SELECT round(sum(b) / sum(n), 6) AS brier, round(sum(l) / sum(n), 6) AS log_loss, round(sum(gap) / sum(n), 6) AS ece, round(max(gap / n), 6) AS mce FROM g"))
def d17_calibration_errors(spark, sf):
    return S.calibration_errors(trials(spark, sf), (F.col("score") + 1) / 2, F.col("same"))


@query()
def d18_platt(spark, sf):
    """Probabilities of a logistic fit, by trial."""
    own = trials(spark, sf)
    m, s, a, b = S.platt(own.cache())
    return own.select("l", "r", F.round(1 / (1 + F.exp(-(a * (F.col("score") - m) / s + b))), 6).alias("p"))


@query(with_tables("stage_samples", "SELECT stage AS metric, 'min' AS direction, round(avg(latency_ms) FILTER (job_id % 2 = 0), 6) AS baseline, round(avg(latency_ms) FILTER (job_id % 2 = 1), 6) AS challenger, coalesce(avg(latency_ms) FILTER (job_id % 2 = 1) <= avg(latency_ms) FILTER (job_id % 2 = 0), false) AS passed FROM stage_samples GROUP BY 1"))
def d20_promotion_gates(spark, sf):
    side = lambda k: F.round(F.avg(F.when(F.col("job_id") % 2 == k, F.col("latency_ms"))), 6)
    return S.gates(stage_samples(spark, sf).groupBy(F.col("stage").alias("metric")).agg(F.lit("min").alias("direction"), side(0).alias("baseline"), side(1).alias("challenger")))


@query(with_tables("trials", "WITH t AS (SELECT * FROM trials WHERE NOT same OR r - l >= 5) SELECT l, r, same, score FROM (SELECT *, row_number() OVER (PARTITION BY same ORDER BY sha256(concat_ws(':', '7', l, r))) AS k FROM t) WHERE k <= least(200, (SELECT min(n) FROM (SELECT count(*) AS n FROM t GROUP BY same)))"))
def c7_balanced_pairs(spark, sf):
    """Clips follow one another by id; pairs of one speaker are at least five places apart."""
    own = trials(spark, sf).select("l", "r", "same", "score", (F.col("r") - F.col("l")).alias("apart"))
    return S.balanced_pairs(own, "7", 200, "apart", 5).drop("apart")


@query(with_tables("trials", "SELECT l, r, score FROM trials"))
def c8_trial_scores(spark, sf):
    return trials(spark, sf).select("l", "r", "score")


@query("SELECT doc_id, sha256(concat_ws(':', 'seed', doc_id)) AS key FROM documents")
def f4_seeded_order(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.seeded_order("seed", "doc_id").alias("key"))


@query(with_tables("trials", "SELECT l, r, l_label, round(cume_dist() OVER (PARTITION BY l_label ORDER BY abs(score)), 9) AS rank FROM trials"))
def e25_percentile_rank(spark, sf):
    own = trials(spark, sf).withColumn("margin", F.abs("score"))
    return S.percentile_rank(own, "margin", ["l_label"]).select("l", "r", "l_label", "rank")


@query(with_tables("trials", "SELECT l, r, score >= 0.1 AS a, score >= 0.25 AS b FROM trials WHERE (score >= 0.1) <> (score >= 0.25)"))
def c10_disagreement(spark, sf):
    """Trials on which two models (two thresholds of one score) differ."""
    a, b = F.col("score") >= 0.1, F.col("score") >= 0.25
    left = trials(spark, sf).select("l", "r", a.alias("a"))
    right = trials(spark, sf).select("l", "r", b.alias("b"))
    return left.join(right, ["l", "r"]).where("a <> b")


CENTRE = "SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2"


@query(f"WITH c AS (SELECT label, list(c ORDER BY i) AS c FROM ({CENTRE}) GROUP BY 1) SELECT e.label, count(*) AS n, round(avg(list_cosine_similarity(e.embedding::DOUBLE[], c.c)), 6) AS cohesion FROM embeddings e JOIN c USING (label) GROUP BY 1")
def d27_centroid_cohesion(spark, sf):
    """Mean cosine of a group's vectors to its mean vector."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    c = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return e.join(c, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(V.cosine("v", "c")), 6).alias("cohesion"))
