"""Queries that iterate: clustering, sequence decoding and frame fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanline.functions.vectors import cosine
from spanline.lineage import cut
from spanline.operators import clustering as K
from spanline.operators import decoding as D
from spanline.operators import graphs as G
from spanline.operators import scoring as S

from .q_intervals import R, merged
from .registry import query
from .tables import segments, table, turns_by_system, turns_ref, with_tables

HOP = 60_000
WEIGHTS = {"a": 1.0, "b": 0.8, "c": 0.6}


def vectors(spark, sf):
    return K.unit_vectors(table(spark, sf, "embeddings"))


def grid(spark, sf):
    return K.frame_grid(turns_by_system(spark, sf), HOP)


@query()
def k1_spherical_kmeans(spark, sf):
    own, _ = K.spherical_kmeans(vectors(spark, sf), 5)
    return own.select("vec_id", "cluster", F.round("similarity", 6).alias("similarity"))


@query("""WITH RECURSIVE u AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT DISTINCT embedding::DOUBLE[] AS v FROM embeddings)),
    m AS (SELECT a.i, list(round(list_dot_product(a.v, b.v) / greatest(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 1e-300), 12) ORDER BY b.i) AS row FROM u a, u b GROUP BY a.i),
    tree AS (SELECT 0::BIGINT AS step, NULL::DOUBLE AS s, list_transform(row, lambda x, k: CASE WHEN k = 1 THEN -9 ELSE x END) AS near FROM m WHERE i = 1
      UNION ALL SELECT step + 1, list_max(near), list_transform(list_zip(near, row), lambda x, k: CASE WHEN x[1] = -9 OR k = m.i THEN -9 ELSE greatest(x[1], x[2]) END) FROM tree JOIN m ON m.i = list_position(near, list_max(near)) WHERE list_max(near) > -9),
    w AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS k, count(*) OVER () AS n FROM tree WHERE step > 0),
    p AS (SELECT n + 2 - k AS n_groups, (coalesce(lag(s) OVER (ORDER BY s DESC), 1.0) - s) / 2 AS score FROM w UNION ALL SELECT 1, (coalesce(min(s), 1.0) + 1) / 2 FROM w)
    SELECT n_groups::BIGINT AS n_groups, round(greatest(0, least(1, score)), 9) AS score, row_number() OVER (ORDER BY round(greatest(0, least(1, score)), 9) DESC, n_groups DESC) = 1 AS best FROM p""")
def k2_connectivity(spark, sf):
    """How long each number of groups lasts while links of ever smaller cosines are added; the longest is the estimate."""
    return G.connectivity_profile(G.cosine_tree(vectors(spark, sf)))


@query("""WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 12) >= 0.4),
    r AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b) SELECT a AS vec_id, min(b) AS label FROM r GROUP BY 1""")
def k2_leader_groups(spark, sf):
    """Groups at a cosine of 0.4: at 0.72 no two of these vectors are linked."""
    return K.leader_groups(vectors(spark, sf), 0.4)


def locked_vectors(spark, sf):
    """Vectors with two locked speakers: labels 3 and 8, every tenth vector of each."""
    lock = F.when(F.col("vec_id") % 10 == 0, F.when(F.col("label") == 3, 0).when(F.col("label") == 8, 1)).cast("int")
    return vectors(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", lock.alias("lock")), "vec_id")


@query()
def k1_locked_kmeans(spark, sf):
    own, _ = K.spherical_kmeans(locked_vectors(spark, sf), 5)
    return own.select("vec_id", "cluster", F.round("similarity", 6).alias("similarity"), "lock")


@query()
def k3_choose_count(spark, sf):
    """Votes of seven measures for two to four speakers, an allowed range that two locked ones bound from below."""
    points = locked_vectors(spark, sf)
    return K.choose_count(points, K.count_bounds(points.count(), "hybrid", 1, 4, locks=2), runs=2)


@query()
def k4_stability(spark, sf):
    """Agreement of a clustering of all vectors with those of seeded resamples of four of five."""
    v = locked_vectors(spark, sf)
    whole, centres = K.spherical_kmeans(v, 4)
    rows = K.stability(v, whole, centres, runs=3, seed="run")
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'int' if k == 'run' else 'double'}" for k in rows[0]))


@query()
def d26_cluster_quality(spark, sf):
    own, centres = K.spherical_kmeans(vectors(spark, sf), 4)
    return K.cluster_quality(own, centres)


@query()
def k5_merge_runs(spark, sf):
    """Runs are vectors, a recording fifty of them in a row; scores are cosines of vectors next to each other by id. Runs that overlap in time stay apart."""
    from spanline.operators import intervals as I

    start = (F.col("vec_id") * 7919 % 600_000).cast("long")
    v = vectors(spark, sf).withColumn("key", F.expr("vec_id div 50")).withColumns({"start_ms": start, "end_ms": start + 4_000})
    l = v.select("key", F.col("vec_id").alias("a"), F.col("v").alias("va"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 5)).alias("b"))
    pairs = l.join(v.select("key", F.col("vec_id").alias("b"), F.col("v").alias("vb")), ["key", "b"]).select("key", "a", "b", F.round(cosine("va", "vb"), 9).alias("score"))
    runs = v.select(F.col("key").alias("recording_id"), F.col("vec_id").alias("run"), "start_ms", "end_ms")
    conflicts = I.overlap_join(runs, runs).where("run < r_run").select(F.col("recording_id").alias("key"), F.col("run").alias("a"), F.col("r_run").alias("b"))
    return K.merge_runs(pairs, 0.3, conflicts)


GRID = f"g AS (SELECT DISTINCT recording_id, system, speaker_id, unnest(range(f, l + 1)) AS frame FROM (SELECT *, CAST(ceil((start_ms - {HOP} / 2) / {HOP}) AS BIGINT) AS f, CAST(ceil((end_ms - {HOP} / 2) / {HOP}) AS BIGINT) - 1 AS l FROM turns_by_system) WHERE f <= l)"
EMIT = "p AS (SELECT recording_id, frame, speaker_id, round(sum(CASE system WHEN 'a' THEN 1.0 WHEN 'b' THEN 0.8 ELSE 0.6 END)::DOUBLE / 2.4, 9) AS p FROM g GROUP BY 1, 2, 3)"


@query(with_tables("turns_by_system", f"WITH {GRID}, {EMIT} SELECT * FROM p"))
def k6_emissions(spark, sf):
    return K.emissions(grid(spark, sf), WEIGHTS)


@query(with_tables("turns_by_system", f"WITH {GRID}, {EMIT}, a AS (SELECT *, frame - row_number() OVER (PARTITION BY recording_id, speaker_id ORDER BY frame) AS run FROM p WHERE p >= 0.5) SELECT recording_id, speaker_id, CAST(min(frame) * {HOP} AS BIGINT) AS start_ms, CAST((max(frame) + 1) * {HOP} AS BIGINT) AS end_ms, round(avg(p), 6) AS mean FROM a GROUP BY recording_id, speaker_id, run"))
def e24_overlap_tracks(spark, sf):
    return K.frame_runs(K.emissions(grid(spark, sf), WEIGHTS).where("p >= 0.5"), ["recording_id", "speaker_id"], HOP, "p")


QUALITY = f"""{GRID}, k AS (SELECT recording_id, frame, speaker_id, count(*) AS systems FROM g GROUP BY 1, 2, 3),
    m AS (SELECT recording_id, system, avg((systems > 1)::INTEGER) AS agreement, count(DISTINCT frame) / 1440.0::DOUBLE AS coverage FROM g JOIN k USING (recording_id, frame, speaker_id) GROUP BY 1, 2),
    o AS (SELECT recording_id, system, count(*) AS turns, count(DISTINCT speaker_id) AS n, avg((end_ms - start_ms <= 60000)::INTEGER) AS short FROM turns_by_system GROUP BY 1, 2),
    r AS (SELECT recording_id, count(*) AS m, sum(coverage) AS covered, list_sort(list(n)) AS counts FROM m JOIN o USING (recording_id, system) GROUP BY 1),
    x AS (SELECT *, (covered - coverage) / greatest(1, m - 1) AS peer, counts[(m - 1) // 2 + 1] AS middle FROM m JOIN o USING (recording_id, system) JOIN r USING (recording_id)),
    quality AS (SELECT recording_id, system, round(agreement, 9) AS agreement, round(coverage, 9) AS coverage, round(greatest(0.12, least(1, (0.48 * CASE WHEN m < 2 THEN 0.5 ELSE agreement END + 0.16 * (1 - CASE WHEN m < 2 THEN 0 ELSE 1 - agreement END) + 0.14 * (1 - short)
      + 0.10 * (1 - least(1, turns / 1440.0::DOUBLE / 28)) + 0.12 * (1 - least(1, abs(n - middle) / greatest(1, middle)::DOUBLE))) * greatest(0.45, 1 - 0.5 * CASE WHEN m > 1 AND peer > 0 THEN least(1, abs(coverage - peer) / greatest(0.1, peer + 0.05)) ELSE 0 END))), 6) AS quality FROM x)"""


@query(with_tables("turns_by_system", f"WITH {QUALITY} SELECT * FROM quality"))
def d34_system_quality(spark, sf):
    """Five weighted terms and the coverage penalty of each system in each recording; turns of a minute or less are short."""
    turns = turns_by_system(spark, sf)
    return K.system_quality(K.frame_grid(turns, HOP), turns, 1440, 60_000, hop_ms=HOP)


@query(with_tables("turns_by_system", f"WITH {QUALITY} SELECT recording_id, system, quality FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY quality DESC, system) AS k FROM quality) WHERE k = 1"))
def f14_best_system(spark, sf):
    """The system of best quality in each recording."""
    turns = turns_by_system(spark, sf)
    scored = K.system_quality(K.frame_grid(turns, HOP), turns, 1440, 60_000, hop_ms=HOP)
    return scored.groupBy("recording_id").agg(F.min(F.struct((-F.col("quality")).alias("q"), "system")).alias("b")).select("recording_id", "b.system", (-F.col("b.q")).alias("quality"))


#: Staying, switching, relief of switching at bounds, and the distance at which a bound fades.
STAY, SWITCH, RELIEF, SNAP_MS = 0.16, 0.42, 0.28, 120_000


def fused_labels(spark, sf):
    """(emissions, labels): one speaker or none a frame, switching being cheaper near the systems' bounds."""
    turns = turns_by_system(spark, sf)
    p = cut(K.emissions(K.frame_grid(turns, HOP), WEIGHTS))
    near = D.boundary_scores(p.select(F.col("recording_id").alias("key"), "frame").distinct(), turns.withColumnRenamed("recording_id", "key"), HOP, SNAP_MS, WEIGHTS)
    return p, D.decode_frame_grid(p, near.withColumnRenamed("key", "recording_id"), SWITCH, STAY, RELIEF)


def _labels_sql() -> str:
    """The best path in a recursive query over frames: scores of all states as a list, and the way to each as a string of their letters."""
    weight = "CASE system WHEN 'a' THEN 1.0 WHEN 'b' THEN 0.8 ELSE 0.6 END::DOUBLE"
    return f"""{GRID}, {EMIT}, bounds AS (SELECT recording_id, start_ms AS pos, {weight} AS w FROM turns_by_system UNION ALL SELECT recording_id, end_ms, {weight} FROM turns_by_system),
    total AS (SELECT recording_id, sum(w) AS total FROM bounds GROUP BY 1),
    spine AS (SELECT recording_id, unnest(range(a, b + 1)) AS frame, a FROM (SELECT recording_id, min(frame) AS a, max(frame) AS b FROM p GROUP BY 1)),
    near AS (SELECT f.recording_id, f.frame, round(sum(w * exp(-abs((f.frame + 0.5) * {HOP} - pos) / {SNAP_MS}.0)) / any_value(total), 9) AS boundary FROM (SELECT DISTINCT recording_id, frame FROM p) f JOIN bounds USING (recording_id) JOIN total USING (recording_id) GROUP BY 1, 2),
    names AS (SELECT recording_id, speaker_id, chr((97 + row_number() OVER (PARTITION BY recording_id ORDER BY speaker_id))::INTEGER) AS code FROM (SELECT DISTINCT recording_id, speaker_id FROM p)),
    states AS (SELECT recording_id, speaker_id, code FROM names UNION ALL SELECT DISTINCT recording_id, '-', 'a' FROM p),
    steps AS (SELECT s.recording_id, s.frame, s.frame - s.a AS t, code, CAST(round(CASE WHEN code = 'a' THEN 0.34 ELSE coalesce(p.p, 0) END * 1000000000) AS BIGINT) AS e,
        CAST(round(greatest(0.0, {SWITCH}::DOUBLE - {RELIEF}::DOUBLE * coalesce(boundary, 0.0)) * 1000000000) AS BIGINT) AS sw
        FROM spine s JOIN states st USING (recording_id) LEFT JOIN p ON p.recording_id = s.recording_id AND p.frame = s.frame AND p.speaker_id = st.speaker_id LEFT JOIN near n ON n.recording_id = s.recording_id AND n.frame = s.frame),
    rows AS (SELECT recording_id, t, list(e ORDER BY code) AS e, list(code ORDER BY code) AS codes, any_value(sw) AS sw FROM steps GROUP BY 1, 2),
    walk AS (SELECT recording_id, t, e AS scores, codes AS paths FROM rows WHERE t = 0
      UNION ALL SELECT recording_id, t, list_transform(scores, lambda x, i: greatest(x + {round(STAY * 10**9)}, best - sw) + e[i]),
        list_transform(scores, lambda x, i: CASE WHEN x + {round(STAY * 10**9)} >= best - sw THEN paths[i] ELSE paths[list_position(scores, best)] END || codes[i])
      FROM (SELECT r.*, w.scores, w.paths, list_max(w.scores) AS best FROM walk w JOIN rows r ON r.recording_id = w.recording_id AND r.t = w.t + 1)),
    done AS (SELECT recording_id, paths[list_position(scores, list_max(scores))] AS path FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t DESC) AS k FROM walk) WHERE k = 1),
    labels AS (SELECT s.recording_id, s.frame, st.speaker_id FROM (SELECT DISTINCT recording_id, frame, t FROM steps) s JOIN done d USING (recording_id) JOIN states st ON st.recording_id = s.recording_id AND st.code = d.path[s.t + 1])"""


@query(with_tables("turns_by_system", f"WITH RECURSIVE {_labels_sql()} SELECT recording_id, speaker_id, CAST(min(frame) * {HOP} AS BIGINT) AS start_ms, CAST((max(frame) + 1) * {HOP} AS BIGINT) AS end_ms FROM (SELECT *, frame - row_number() OVER (PARTITION BY recording_id, speaker_id ORDER BY frame) AS run FROM labels WHERE speaker_id <> '-') GROUP BY recording_id, speaker_id, run"))
def e23_frame_fusion(spark, sf):
    _, labels = fused_labels(spark, sf)
    return K.frame_runs(labels.where("speaker_id <> '-'"), ["recording_id", "speaker_id"], HOP)


def scored_turns(spark, sf):
    """Turns with scores of three roles from segment arithmetic; every seventh place is locked to one role, every eleventh turn a given anchor."""
    roles = F.array(*[F.struct(F.lit(r).alias("speaker_id"), F.when(F.lit(r) == F.col("speaker_id"), F.col("confidence")).otherwise((1 - F.col("confidence")) / 2).alias("score")) for r in ("assistant", "system", "user")])
    locked = F.when((F.col("recording_id") + F.col("turn")) % 7 == 0, "assistant")
    return segments(spark, sf).select(F.col("recording_id").alias("key"), F.col("turn").alias("turn_id"), "start_ms", "end_ms", "speaker_id", locked.alias("locked"), (locked.isNull() & ((F.col("recording_id") + F.col("turn")) % 11 == 5)).alias("strong"), roles.alias("scores"))


@query(with_tables("segments", f"""WITH RECURSIVE s AS (SELECT recording_id, turn, speaker_id AS own, confidence, row_number() OVER w AS t, exp(-greatest(0, coalesce(start_ms - lag(end_ms) OVER w, 0)) / {D.FADE_MS}.0::DOUBLE) AS near,
      CASE WHEN (recording_id + turn) % 7 = 0 THEN 'assistant' END AS locked, (recording_id + turn) % 7 <> 0 AND (recording_id + turn) % 11 = 5 AS strong FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms, end_ms, turn)),
    e AS (SELECT *, CASE WHEN role = own THEN confidence ELSE (1 - confidence) / 2 END AS score FROM s, (SELECT unnest(['assistant', 'system', 'user']) AS role)),
    r AS (SELECT *, row_number() OVER w AS k, first_value(role) OVER w AS top, first_value(score) OVER w AS best, nth_value(score, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM e WINDOW w AS (PARTITION BY recording_id, t ORDER BY score DESC, role)),
    c AS (SELECT recording_id, turn, t, own, role, CAST(round(score * 1000000000) AS BIGINT) AS e, CAST(round({D.STAY}::DOUBLE * near * 1000000000) AS BIGINT) AS stay, CAST(round({D.SWITCH}::DOUBLE * near * 1000000000) AS BIGINT) AS switch
      FROM r WHERE CASE WHEN locked IS NOT NULL THEN role = locked WHEN strong OR (top = own AND best >= {D.ANCHOR[0]} AND round(best - second, 12) >= {D.ANCHOR[1]}) THEN role = own ELSE k <= 2 OR role = own END),
    w AS (SELECT recording_id, t, [role] AS path, e AS total FROM c WHERE t = 1
      UNION ALL SELECT c.recording_id, c.t, list_append(path, role), total + e + CASE WHEN path[-1] = role THEN stay ELSE -switch END FROM w JOIN c ON c.recording_id = w.recording_id AND c.t = w.t + 1),
    best AS (SELECT recording_id, path FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t DESC, total DESC, list_reverse(path)) AS k FROM w) WHERE k = 1)
    SELECT s.recording_id, s.turn, s.own AS speaker_id, path[s.t] AS decoded FROM s JOIN best USING (recording_id)"""))
def e22_speaker_sequence(spark, sf):
    """The best path under locks and anchors, two candidates a turn besides the own speaker."""
    path = D.decode_turns(scored_turns(spark, sf), top=2, protect=None)
    return path.select(F.col("key").alias("recording_id"), F.col("turn_id").alias("turn"), "speaker_id", "decoded")


@query()
def e22_protected_sequence(spark, sf):
    """As e22_speaker_sequence, and speakers that lost all their turns get one back; with reasons."""
    path = D.decode_turns(scored_turns(spark, sf), top=2, protect="all")
    return path.select(F.col("key").alias("recording_id"), F.col("turn_id").alias("turn"), "speaker_id", "decoded", "score", F.array_join("reasons", ",").alias("reasons"))


@query(with_tables("turns_by_system turns_ref", f"WITH {GRID}, {EMIT}, t AS (SELECT DISTINCT recording_id, speaker_id, unnest(range(f, l + 1)) AS frame FROM (SELECT *, CAST(ceil((start_ms - {HOP} / 2) / {HOP}) AS BIGINT) AS f, CAST(ceil((end_ms - {HOP} / 2) / {HOP}) AS BIGINT) - 1 AS l FROM turns_ref) WHERE f <= l), j AS (SELECT t.frame IS NOT NULL AS truth, coalesce(p.p >= 0.5, false) AS pred FROM t FULL JOIN p ON t.recording_id = p.recording_id AND t.speaker_id = p.speaker_id AND t.frame = p.frame), c AS (SELECT count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn, count(*) FILTER (NOT truth AND NOT pred) AS tn FROM j) SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c"))
def k8_activity_f1(spark, sf):
    truth = K.frame_grid(turns_ref(spark, sf).withColumn("system", F.lit("ref")), HOP).select("recording_id", "speaker_id", "frame", F.lit(True).alias("t"))
    both = truth.join(K.emissions(grid(spark, sf), WEIGHTS), ["recording_id", "speaker_id", "frame"], "full_outer")
    return S.binary_metrics(both, F.coalesce("t", F.lit(False)), F.coalesce(F.col("p") >= 0.5, F.lit(False)))


@query(with_tables("turns_by_system", f"WITH {GRID}, v AS (SELECT recording_id, frame, speaker_id, count(DISTINCT system) AS n FROM g GROUP BY 1, 2, 3), w AS (SELECT *, row_number() OVER o AS k, lead(n) OVER o AS next FROM v WINDOW o AS (PARTITION BY recording_id, frame ORDER BY n DESC, speaker_id DESC)) SELECT recording_id, frame, speaker_id, n AS n_systems FROM w WHERE k = 1 AND n >= 2 AND (next IS NULL OR n > next)"))
def k9_consensus_labels(spark, sf):
    return K.consensus_labels(grid(spark, sf))


@query()
def k7_calibrator(spark, sf):
    """Logistic weights of three systems' activity against the reference, by frame and speaker."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    g = grid(spark, sf)
    truth = K.frame_grid(turns_ref(spark, sf).withColumn("system", F.lit("ref")), HOP).select("recording_id", "speaker_id", "frame", F.lit(1.0).alias("label"))
    wide = g.groupBy("recording_id", "speaker_id", "frame").agg(*[F.max((F.col("system") == s).cast("double")).alias(s) for s in WEIGHTS])
    rows = wide.join(truth, ["recording_id", "speaker_id", "frame"], "full_outer").fillna(0.0, [*WEIGHTS, "label"])
    x = VectorAssembler(inputCols=list(WEIGHTS), outputCol="features").transform(rows)
    model = LogisticRegression(maxIter=20, regParam=1e-4).fit(x)
    out = [(s, round(float(w), 4)) for s, w in zip(WEIGHTS, model.coefficients)] + [("bias", round(float(model.intercept), 4))]
    return spark.createDataFrame(out, "feature string, weight double")


@query(with_tables("turns_ref turns_by_system", f"""WITH RECURSIVE {R}, h AS ({merged('(SELECT * FROM turns_by_system)', 0, 'recording_id, speaker_id, system')}),
    m AS (SELECT r.recording_id || ':' || system AS id, r.recording_id, system, r.speaker_id AS ref_speaker, h.speaker_id AS hyp_speaker, CAST(sum(least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms)) AS BIGINT) AS overlap_ms FROM r JOIN h ON r.recording_id = h.recording_id AND r.start_ms < h.end_ms AND h.start_ms < r.end_ms GROUP BY ALL),
    refs AS (SELECT id, ref_speaker, row_number() OVER (PARTITION BY id ORDER BY ref_speaker) AS k FROM m GROUP BY 1, 2),
    walk AS (SELECT DISTINCT id, 0::BIGINT AS k, []::VARCHAR[] AS used, 0::BIGINT AS ms FROM refs
      UNION ALL SELECT id, k, CASE WHEN hyp_speaker IS NULL THEN used ELSE list_append(used, hyp_speaker) END, ms + coalesce(overlap_ms, 0) FROM (
        SELECT w.id, f.k, w.used, w.ms, m.hyp_speaker, m.overlap_ms, row_number() OVER (PARTITION BY w.id ORDER BY m.overlap_ms DESC NULLS LAST, m.hyp_speaker) AS place
        FROM walk w JOIN refs f ON f.id = w.id AND f.k = w.k + 1 LEFT JOIN m ON m.id = f.id AND m.ref_speaker = f.ref_speaker AND NOT list_contains(w.used, m.hyp_speaker)) WHERE place = 1),
    total AS (SELECT split_part(id, ':', 1) AS recording_id, split_part(id, ':', 2) AS system, max(ms) AS ms FROM walk GROUP BY 1, 2)
    SELECT recording_id, system, ms FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY ms DESC, system DESC) AS k FROM total) WHERE k = 1"""))
def k10_best_system(spark, sf):
    """The system whose mapped time agrees most with the reference."""
    from spanline.operators import diarization as D
    from spanline.operators import intervals as I

    ref, out = turns_ref(spark, sf), None
    for s in WEIGHTS:
        m = D.greedy_map(I.overlap_matrix(ref, turns_by_system(spark, sf).where(F.col("system") == s).drop("system")))
        own = m.groupBy("recording_id").agg(F.sum("overlap_ms").alias("ms")).withColumn("system", F.lit(s))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("recording_id").agg(F.max(F.struct("ms", "system")).alias("b")).select("recording_id", F.col("b.system").alias("system"), F.col("b.ms").alias("ms"))


@query(with_tables("turns_by_system", f"""WITH RECURSIVE {_labels_sql()}, lost AS (SELECT *, frame - row_number() OVER (PARTITION BY recording_id, speaker_id ORDER BY frame) AS run FROM p ANTI JOIN labels USING (recording_id, speaker_id)),
    runs AS (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker_id ORDER BY n DESC, mean DESC, a) AS k FROM (SELECT recording_id, speaker_id, run, count(*) AS n, round(avg(p), 9) AS mean, min(frame) AS a FROM lost GROUP BY 1, 2, 3)),
    back AS (SELECT recording_id, frame, speaker_id AS back FROM (SELECT l.*, row_number() OVER (PARTITION BY l.recording_id, l.frame ORDER BY l.p DESC, l.speaker_id) AS place FROM lost l JOIN runs r ON r.k = 1 AND l.recording_id = r.recording_id AND l.speaker_id = r.speaker_id AND l.run = r.run) WHERE place = 1)
    SELECT recording_id, frame, coalesce(back, speaker_id) AS speaker_id, back IS NOT NULL AS restored FROM labels LEFT JOIN back USING (recording_id, frame)"""))
def k11_restore_speakers(spark, sf):
    """The fused labels, with speakers that fusion lost put back at their longest run."""
    p, labels = fused_labels(spark, sf)
    return D.with_lost_speakers(labels, p)
