"""Queries on mapped tracks, edit counts, snapped cuts, proposals and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.functions.vectors import cosine
from spanline.operators import diarization as D
from spanline.operators import evidence as E
from spanline.operators import intervals as I
from spanline.operators import review as R
from spanline.operators.scoring import seeded_order

from .q_intervals import DER, OVER, RATE, SETS, SWEEP, merged
from .q_intervals import R as RUNS
from .registry import query
from .tables import SYSTEMS, doc_pairs, segments, table, trials, turns_by_system, turns_hyp, turns_ref, with_tables


@query(with_tables("turns_by_system turns_ref", f"""WITH RECURSIVE {RUNS}, t AS (SELECT event_id, recording_id, 'track-' || ascii(speaker_id) AS speaker_id, start_ms, end_ms FROM turns_by_system WHERE system = 'b'), h AS ({merged('t')}), m AS ({OVER}),
    refs AS (SELECT recording_id, ref_speaker, row_number() OVER (PARTITION BY recording_id ORDER BY ref_speaker) AS k FROM m GROUP BY 1, 2),
    walk AS (SELECT DISTINCT recording_id, 0 AS k, []::VARCHAR[] AS used, []::VARCHAR[] AS names, 0::BIGINT AS total FROM refs
      UNION ALL SELECT w.recording_id, w.k + 1, CASE WHEN m.hyp_speaker IS NULL THEN w.used ELSE list_append(w.used, m.hyp_speaker) END, CASE WHEN m.hyp_speaker IS NULL THEN w.names ELSE list_append(w.names, m.ref_speaker) END, w.total + coalesce(m.overlap_ms, 0)
      FROM walk w JOIN refs f ON f.recording_id = w.recording_id AND f.k = w.k + 1 JOIN (SELECT recording_id, ref_speaker, hyp_speaker, overlap_ms FROM m UNION ALL SELECT recording_id, ref_speaker, NULL, 0 FROM refs) m ON m.recording_id = f.recording_id AND m.ref_speaker = f.ref_speaker AND (m.hyp_speaker IS NULL OR NOT list_contains(w.used, m.hyp_speaker))),
    best AS (SELECT recording_id, arg_max(used, total) AS used, arg_max(names, total) AS names FROM walk GROUP BY 1), map AS (SELECT recording_id, unnest(used) AS hyp_speaker, unnest(names) AS ref_speaker FROM best),
    lead AS (SELECT *, lead(overlap_ms, 1, 0) OVER (PARTITION BY recording_id, hyp_speaker ORDER BY overlap_ms DESC, ref_speaker) AS next_ms, sum(overlap_ms) OVER (PARTITION BY recording_id, hyp_speaker) AS all_ms FROM m),
    clear AS (SELECT map.* FROM map JOIN lead USING (recording_id, hyp_speaker, ref_speaker) WHERE (overlap_ms - next_ms) / all_ms >= 0.1)
    SELECT t.event_id, t.recording_id, coalesce(c.ref_speaker, '~' || t.speaker_id) AS speaker_id, t.start_ms, t.end_ms FROM t LEFT JOIN clear c ON c.recording_id = t.recording_id AND c.hyp_speaker = t.speaker_id"""))
def c21_map_tracks(spark, sf):
    tracks = turns_by_system(spark, sf).where("system = 'b'").withColumn("speaker_id", F.concat(F.lit("track-"), F.ascii("speaker_id").cast("string"))).drop("system")
    return E.map_tracks(turns_ref(spark, sf), tracks)


@query()
def d36_edit_counts(spark, sf):
    return doc_pairs(spark, sf).select("doc_id", E.edit_count_column("ref_words", "hyp_words").alias("c"), F.size("ref_words").alias("n")).select("doc_id", "c.*", "n")


@query()
def d37_concatenated_error_rate(spark, sf):
    """Speakers renamed and every seventh word left out."""
    words = segments(spark, sf).select("recording_id", "speaker_id", "turn", F.split("text", r"\s+").alias("words"))
    fewer = F.expr("transform(filter(transform(words, (x, i) -> struct(x AS x, i AS i)), s -> s.i % 7 <> 6), s -> s.x)")
    return E.concatenated_error_rate(words, words.select("recording_id", F.concat(F.lit("spk-"), F.length("speaker_id").cast("string")).alias("speaker_id"), "turn", fewer.alias("words")))


def retold(spark, sf):
    """Segments with words, and the same with speakers renamed and every seventh word left out."""
    own = segments(spark, sf).withColumn("words", F.split("text", r"\s+"))
    fewer = F.expr("transform(filter(transform(words, (x, i) -> struct(x AS x, i AS i)), s -> s.i % 7 <> 6), s -> s.x)")
    return own, own.withColumn("speaker_id", F.concat(F.lit("spk-"), F.length("speaker_id").cast("string"))).withColumn("words", fewer)


@query()
def d37_attributed_error_rate(spark, sf):
    """Speakers are mapped by their common time."""
    ref, hyp = retold(spark, sf)
    turns = lambda df: df.select(F.xxhash64("segment_id").alias("event_id"), "recording_id", "speaker_id", "start_ms", "end_ms")
    words = lambda df: df.select("recording_id", "speaker_id", "turn", "words")
    return E.attributed_error_rate(words(ref), words(hyp), turns(ref), turns(hyp))


@query()
def d37_time_constrained_error_rate(spark, sf):
    """Words match within five seconds of their share of the segment's time."""
    return E.time_constrained_error_rate(*[E.timed_words(df) for df in retold(spark, sf)])


REF3 = " UNION ALL ".join(f"SELECT event_id, '{n}:' || recording_id AS recording_id, speaker_id, start_ms, end_ms FROM turns_ref" for n, *_ in SYSTEMS)


@query(with_tables("turns_by_system", f"WITH r3 AS ({REF3}), h3 AS (SELECT event_id, system || ':' || recording_id AS recording_id, speaker_id, start_ms, end_ms FROM turns_by_system), r AS ({merged('r3')}), h AS ({merged('h3')}), {SWEEP}, d AS ({DER}) SELECT *, {RATE} FROM d"))
def d43_system_errors(spark, sf):
    """The error rates of each system's whole timeline."""
    ref = turns_ref(spark, sf)
    own = turns_by_system(spark, sf)
    keyed = ref.withColumn("system", F.explode(F.array(*[F.lit(n) for n, *_ in SYSTEMS])))
    name = lambda df: df.withColumn("recording_id", F.concat("system", F.lit(":"), "recording_id")).drop("system")
    return D.diarization_error(name(keyed), name(own))


@query()
def e9_match_points(spark, sf):
    """The starts of both sides' turns, one to one with the least sum of distances."""
    point = lambda df: df.select("recording_id", F.col("start_ms").alias("t")).distinct()
    return E.match_points(point(turns_ref(spark, sf)), point(turns_hyp(spark, sf)))


@query(with_tables("turns_ref", "WITH c AS (SELECT DISTINCT recording_id, CAST(floor(86400000 * k / 8.0::DOUBLE) AS BIGINT) AS cut FROM turns_ref, (SELECT unnest(range(1, 8)) AS k)), n AS (SELECT c.recording_id, cut, start_ms, row_number() OVER (PARTITION BY c.recording_id, cut ORDER BY abs(start_ms - cut), start_ms) AS k FROM c JOIN turns_ref t ON t.recording_id = c.recording_id AND start_ms BETWEEN cut - 300000 AND cut + 300000) SELECT c.recording_id, c.cut, coalesce(n.start_ms, c.cut) AS snapped FROM c LEFT JOIN n ON n.recording_id = c.recording_id AND n.cut = c.cut AND n.k = 1"))
def e30_snapped_cuts(spark, sf):
    ref = turns_ref(spark, sf)
    spans = ref.select("recording_id").distinct().withColumn("duration_ms", F.lit(86_400_000).cast("long"))
    return E.snapped_cuts(spans, ref.select("recording_id", F.col("start_ms").alias("t")), 8, 300_000)


@query(with_tables("turns_ref turns_hyp", """WITH i AS (SELECT r.recording_id, r.event_id, greatest(r.start_ms, h.start_ms) AS a, least(r.end_ms, h.end_ms) AS b FROM turns_ref r JOIN turns_hyp h ON r.recording_id = h.recording_id AND r.start_ms < h.end_ms AND h.start_ms < r.end_ms),
    t AS (SELECT recording_id, event_id, a AS t FROM i UNION SELECT recording_id, event_id, b FROM i UNION SELECT recording_id, event_id, start_ms FROM turns_ref UNION SELECT recording_id, event_id, end_ms FROM turns_ref),
    p AS (SELECT * FROM (SELECT recording_id, event_id, t AS start_ms, lead(t) OVER (PARTITION BY event_id ORDER BY t) AS end_ms FROM t) WHERE end_ms IS NOT NULL),
    o AS (SELECT p.event_id, p.start_ms, h.speaker_id, sum(least(p.end_ms, h.end_ms) - greatest(p.start_ms, h.start_ms)) AS ms FROM p JOIN turns_hyp h ON p.recording_id = h.recording_id AND p.start_ms < h.end_ms AND h.start_ms < p.end_ms GROUP BY 1, 2, 3),
    w AS (SELECT event_id, start_ms, speaker_id, row_number() OVER (PARTITION BY event_id, start_ms ORDER BY ms DESC, speaker_id DESC) AS k FROM o)
    SELECT p.recording_id, p.event_id, p.start_ms, p.end_ms, w.speaker_id FROM p LEFT JOIN w ON w.event_id = p.event_id AND w.start_ms = p.start_ms AND w.k = 1"""))
def e31_project_turns(spark, sf):
    return E.project_turns(turns_ref(spark, sf), turns_hyp(spark, sf))


@query(with_tables("trials", "SELECT bucket, l, r FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256(concat_ws(':', 'case', l, r))) AS k FROM (SELECT l, r, CASE WHEN (score >= 0.1) <> (score >= 0.25) THEN 'disputed' WHEN (score >= 0.25) <> same THEN 'both-wrong' ELSE 'agreed' END AS bucket FROM trials)) WHERE k <= 20"))
def f8_dispute_cases(spark, sf):
    """Twenty cases of each kind by seeded order: one top-k a kind."""
    a, b = F.col("score") >= 0.1, F.col("score") >= 0.25
    own = trials(spark, sf).select("l", "r", F.when(a != b, "disputed").when(b != F.col("same"), "both-wrong").otherwise("agreed").alias("bucket"))
    parts = [own.where(F.col("bucket") == k).orderBy(seeded_order("case", "l", "r")).limit(20) for k in ("disputed", "both-wrong", "agreed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("bucket", "l", "r")


SWITCH = """WITH s AS (SELECT recording_id, turn, start_ms, end_ms, speaker_id <> lag(speaker_id) OVER (PARTITION BY recording_id ORDER BY turn) AS switched FROM segments)
    SELECT recording_id, turn, l_turn, r_turn FROM (SELECT i.recording_id, i.turn, l.turn AS l_turn, r.turn AS r_turn, row_number() OVER (PARTITION BY i.recording_id, i.turn ORDER BY least(i.start_ms - l.start_ms, r.end_ms - i.start_ms) DESC, l.turn, r.turn) AS k
    FROM s i JOIN s l ON l.recording_id = i.recording_id AND l.turn < i.turn JOIN s r ON r.recording_id = i.recording_id AND r.turn >= i.turn WHERE i.switched AND r.end_ms - l.start_ms <= 120000) WHERE k = 1"""


@query(with_tables("segments", SWITCH))
def f12_switch_window(spark, sf):
    """The most balanced window of at most two minutes around each change of speaker."""
    from pyspark.sql import Window

    s = segments(spark, sf).select("recording_id", "turn", "start_ms", "end_ms", (F.col("speaker_id") != F.lag("speaker_id").over(Window.partitionBy("recording_id").orderBy("turn"))).alias("switched"))
    # both ends lie within two minutes of the change, so in its own bucket of two minutes or the one before or after
    size = 120_000
    near = lambda c, *steps: F.explode(F.array(*[F.floor(F.col(c) / size) + k for k in steps])).alias("bucket")
    i = s.where("switched").select("recording_id", "turn", F.col("start_ms").alias("at"))
    l = s.select("recording_id", F.col("turn").alias("l_turn"), F.col("start_ms").alias("l_start"), F.floor(F.col("start_ms") / size).alias("bucket"))
    r = s.select("recording_id", F.col("turn").alias("r_turn"), F.col("end_ms").alias("r_end"), F.floor(F.col("end_ms") / size).alias("bucket"))
    left = i.select("*", near("at", -1, 0)).join(l, ["recording_id", "bucket"]).where("l_turn < turn AND at - l_start <= 120000").drop("bucket")
    w = left.select("*", near("at", 0, 1)).join(r, ["recording_id", "bucket"]).where("r_turn >= turn AND r_end - l_start <= 120000")
    best = F.min(F.struct((-F.least(F.col("at") - F.col("l_start"), F.col("r_end") - F.col("at"))).alias("b"), "l_turn", "r_turn")).alias("x")
    return w.groupBy("recording_id", "turn").agg(best).select("recording_id", "turn", "x.l_turn", "x.r_turn")


@query(with_tables("turns_ref", f"""WITH RECURSIVE q AS ({SETS.format(n='= 1', alias=' AS speaker_id')}), w AS (SELECT DISTINCT recording_id, speaker_id, unnest(list_append(range(start_ms, end_ms - 30000 + 1, 15000), end_ms - 30000)) AS s FROM q WHERE end_ms - start_ms >= 30000),
    k AS (SELECT recording_id, speaker_id, min(s) AS s FROM w GROUP BY 1, 2
      UNION ALL SELECT recording_id, speaker_id, next FROM (SELECT k.recording_id, k.speaker_id, (SELECT min(w.s) FROM w WHERE w.recording_id = k.recording_id AND w.speaker_id = k.speaker_id AND w.s >= k.s + 600000) AS next FROM k) WHERE next IS NOT NULL)
    SELECT recording_id, speaker_id, s AS start_ms, s + 30000 AS end_ms FROM k"""))
def f13_thinned_windows(spark, sf):
    """Windows of half a minute inside solo spans, at half steps, with middles at least ten minutes apart."""
    w = I.sliding_windows(I.solo_spans(turns_ref(spark, sf)), 30_000, 15_000)
    return E.thinned(w, ["recording_id", "speaker_id"], 600_000)


@query(with_tables("turns_ref", f"SELECT recording_id, speakers, greatest(start_ms - 1000, 0) AS start_ms, least(end_ms, start_ms + 600000) + 1000 AS end_ms FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms) AS k FROM ({SETS.format(n='>= 2', alias='')}) WHERE len(string_split(speakers, '+')) = 2) WHERE k <= 5"))
def f15_recovery_intervals(spark, sf):
    """The first five overlaps of exactly two speakers in each recording, cut at ten minutes, padded by a second."""
    from pyspark.sql import Window

    two = I.overlap_regions(turns_ref(spark, sf)).where("size(split(speakers, '[+]')) = 2")
    first = two.withColumn("k", F.row_number().over(Window.partitionBy("recording_id").orderBy("start_ms"))).where("k <= 5")
    end = F.least(F.col("end_ms"), F.col("start_ms") + 600_000) + 1000
    return first.select("recording_id", "speakers", F.greatest(F.col("start_ms") - 1000, F.lit(0)).alias("start_ms"), end.alias("end_ms"))


KEYS = r'''WITH s AS (SELECT doc_id, string_split_regex(text, '[\p{L}\p{N}]+') AS gaps, regexp_extract_all(text, '[\p{L}\p{N}]+') AS words FROM documents),
    w AS (SELECT * FROM (SELECT doc_id, unnest(range(1, len(gaps) + 1)) AS k, unnest(gaps) AS gap, unnest(words) AS word FROM s) WHERE word IS NOT NULL),
    p AS (SELECT doc_id, word, length(word) AS n, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY k) - length(word) + 1 AS INTEGER) AS "at" FROM w)
    SELECT doc_id, "at", CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, "at") AS place FROM p WHERE regexp_full_match(word, '[A-Z][a-z]{5,}')) WHERE place <= 3'''


@query(KEYS)
def f19_keyword_spans(spark, sf):
    return E.keyword_spans(table(spark, sf, "documents"), r"[\p{L}\p{N}]+", "[A-Z][a-z]{5,}", 3)


@query(with_tables("turns_ref", "SELECT recording_id, number, CAST(floor(start_ms * f) AS BIGINT) AS start_ms, CAST(floor(end_ms * f) AS BIGINT) AS end_ms, squeezed FROM (SELECT *, CASE WHEN last > 80000000 THEN 80000000 / last::DOUBLE ELSE 1.0 END AS f, last > 80000000 AS squeezed FROM (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, event_id) AS number, start_ms, end_ms, max(end_ms) OVER (PARTITION BY recording_id) AS last FROM turns_ref))"))
def l10_bounded_cues(spark, sf):
    from pyspark.sql import Window

    ref = turns_ref(spark, sf)
    cues = ref.select("recording_id", F.row_number().over(Window.partitionBy("recording_id").orderBy("start_ms", "event_id")).cast("long").alias("number"), "start_ms", "end_ms")
    return E.bounded_cues(cues, ref.select("recording_id").distinct().withColumn("duration_ms", F.lit(80_000_000).cast("long")))


@query(with_tables("segments", """WITH RECURSIVE o AS (SELECT recording_id, segment_id, length(text) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, segment_id) AS k FROM segments),
    b AS (SELECT recording_id, segment_id, k, 0::BIGINT AS batch, 1::BIGINT AS items, n::BIGINT AS chars FROM o WHERE k = 1 UNION ALL SELECT o.recording_id, o.segment_id, o.k, CASE WHEN items >= 3 OR chars + n > 1500 THEN batch + 1 ELSE batch END, CASE WHEN items >= 3 OR chars + n > 1500 THEN 1 ELSE items + 1 END, CASE WHEN items >= 3 OR chars + n > 1500 THEN n ELSE chars + n END FROM b JOIN o ON o.recording_id = b.recording_id AND o.k = b.k + 1),
    g AS (SELECT recording_id, batch, list(segment_id ORDER BY items) AS ids FROM b GROUP BY 1, 2)
    SELECT recording_id, batch, array_to_string(list_concat(tail, ids), ',') AS segments, len(tail)::BIGINT AS n_context FROM (SELECT *, coalesce(lag(ids) OVER (PARTITION BY recording_id ORDER BY batch)[-1:], []) AS tail FROM g)"""))
def l12_overlapping_windows(spark, sf):
    return E.overlapping_windows(segments(spark, sf), 3, 1500, 1)


@query("SELECT doc_id, string_agg(note, ' ' ORDER BY chunk) AS note FROM (SELECT doc_id, chunk, max(first) AS note FROM (SELECT doc_id, CAST(floor(before / 800) AS BIGINT) AS chunk, length(l)::VARCHAR AS first, row_number() OVER (PARTITION BY doc_id, CAST(floor(before / 800) AS BIGINT) ORDER BY i) AS k FROM (SELECT doc_id, i, l, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))) WHERE k = 1 GROUP BY 1, 2) GROUP BY 1")
def l14_tree_summary(spark, sf):
    """A note for each chunk (its first line's length), merged by fours until one is left."""
    lines = R.text_chunks(table(spark, sf, "documents"), 800)
    notes = lines.groupBy("doc_id", "chunk").agg(F.min_by("n", "line").cast("string").alias("note"))
    return E.tree_reduce(notes, 4, lambda notes: F.array_join(notes, " "))


@query(with_tables("segments", "SELECT recording_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, string_agg(text, ' ' ORDER BY start_ms) AS text FROM (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start_ms, segment_id) AS run FROM (SELECT *, CASE WHEN turn % 2 = 1 AND lag(speaker_id) OVER w = speaker_id AND start_ms - lag(end_ms) OVER w <= 500 THEN 0 ELSE 1 END AS new FROM segments WINDOW w AS (PARTITION BY recording_id ORDER BY start_ms, segment_id))) GROUP BY recording_id, run"))
def l16_merge_proposals(spark, sf):
    s = segments(spark, sf)
    return E.merge_proposed(s, s.where("turn % 2 = 1").select("segment_id"), 500)


@query(with_tables("segments", "SELECT segment_id, CASE WHEN turn % 3 = 1 AND confidence < 0.6 AND speaker_id <> 'system' THEN 'assistant' ELSE speaker_id END AS speaker_id, turn % 3 = 1 AND confidence < 0.6 AND speaker_id <> 'system' AS applied FROM segments"))
def l19_apply_proposals(spark, sf):
    """Proposed speakers apply to unprotected segments that are not sure of themselves."""
    s = segments(spark, sf)
    p = s.where("turn % 3 = 1").select("segment_id", F.lit("assistant").alias("to"))
    ok = F.col("to").isNotNull() & (F.col("confidence") < 0.6) & (F.col("speaker_id") != "system")
    return s.join(p, "segment_id", "left").select("segment_id", F.when(ok, F.col("to")).otherwise(F.col("speaker_id")).alias("speaker_id"), ok.alias("applied"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e),
    c AS (SELECT label AS "to", list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM x GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT vec_id, "to", round(list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))), 9) AS s FROM e, c),
    t AS (SELECT *, row_number() OVER w AS k, s - lead(s) OVER w AS lead FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY s DESC, "to"))
    SELECT vec_id, CASE WHEN lead >= 0.05 THEN "to" END AS speaker, round(lead, 6) AS lead, lead < 0.05 AS review FROM t WHERE k = 1""")
def l20_overlap_assignment(spark, sf):
    """Each vector to the nearest mean vector of the labels, or to review if the second is too near."""
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    c = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy(F.col("label").alias("to")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("s"), "to")
    ways = e.crossJoin(F.broadcast(c)).select("vec_id", "label", "to", F.round(cosine("v", "c"), 9).alias("s"))
    top = ways.withColumn("k", F.row_number().over(w)).withColumn("lead", F.col("s") - F.lead("s").over(w)).where("k = 1")
    return top.select("vec_id", F.when(F.col("lead") >= 0.05, F.col("to")).alias("speaker"), F.round("lead", 6).alias("lead"), (F.col("lead") < 0.05).alias("review"))

