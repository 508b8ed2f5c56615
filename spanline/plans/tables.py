"""Input tables of the queries, derived from the given ones: in Spark, and as DuckDB SQL under the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: The event types in alphabetical order; a turn's speaker.
SPEAKERS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording is a day, a speaker an event type, a turn an event with a length from its value."""
    start = F.expr("CAST(timestampdiff(MILLISECOND, date_trunc('DAY', ts), ts) AS BIGINT)")
    ev = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("recording_id"), F.col("event_type").alias("speaker_id"), start.alias("start_ms"), F.floor(F.col("value") * 10000).cast("long").alias("d"))
    return ev.select("event_id", "recording_id", "speaker_id", "start_ms", F.least(F.col("start_ms") + F.col("d"), F.lit(DAY_MS)).cast("long").alias("end_ms")).where("end_ms > start_ms")


def shifted(turns: DataFrame, drop: int, relabel: int, step: int) -> DataFrame:
    """A second system's turns: every drop-th left out, bounds moved, every relabel-th given to the next speaker."""
    move = (F.col("event_id") % 7 - 3) * step
    clip = lambda c: F.least(F.greatest(F.col(c) + move, F.lit(0)), F.lit(DAY_MS)).cast("long")
    after = F.create_map(*[F.lit(x) for k, s in enumerate(SPEAKERS) for x in (s, SPEAKERS[(k + 1) % len(SPEAKERS)])])
    speaker = F.when(F.col("event_id") % relabel == 0, after[F.col("speaker_id")]).otherwise(F.col("speaker_id"))
    return turns.where(F.col("event_id") % drop != 0).select("event_id", "recording_id", speaker.alias("speaker_id"), clip("start_ms").alias("start_ms"), clip("end_ms").alias("end_ms")).where("end_ms > start_ms")


def turns_hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shifted(turns_ref(spark, sf_dir), 11, 13, 15000)


def turns_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = turns_ref(spark, sf_dir)
    a, b, c = (shifted(ref, d, r, s).withColumn("system", F.lit(n)) for n, d, r, s in SYSTEMS)
    return a.unionByName(b).unionByName(c)


SYSTEMS = (("a", 5, 17, 4000), ("b", 7, 13, 9000), ("c", 11, 7, 15000))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording is a conversation, a segment a turn of it, one after the other."""
    from pyspark.sql import Window

    conv = table(spark, sf_dir, "conversations")
    n = F.length("text")
    duration = F.greatest(F.lit(900), F.ceil(n * 1000 / 17)).cast("long")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("lang_id"), F.col("lang").alias("language"))
    base = conv.withColumn("d", duration).withColumn("start_ms", (F.coalesce(F.sum("d").over(w), F.lit(0)) + 80 * F.col("turn")).cast("long"))
    return base.join(langs, F.expr("conv_id % 1000 = lang_id"), "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("segment_id"), F.col("conv_id").alias("recording_id"), "turn", F.col("role").alias("speaker_id"), "start_ms", (F.col("start_ms") + F.col("d")).alias("end_ms"), "text",
        (((F.col("conv_id") * 31 + F.col("turn") * 17) % 100) / 100.0).cast("double").alias("confidence"), "language",
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of neighbouring ids with their cosine; a pair is the same speaker if the labels are."""
    from spanline.functions.vectors import cosine

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    left = e.select(F.col("vec_id").alias("l"), F.col("v").alias("lv"), F.col("label").alias("l_label"), F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 20)).alias("r"))
    right = e.select(F.col("vec_id").alias("r"), F.col("v").alias("rv"), F.col("label").alias("r_label"))
    return left.join(right, "r").select("l", "r", "l_label", "r_label", (F.col("l_label") == F.col("r_label")).alias("same"), F.round(cosine("lv", "rv"), 9).alias("score"))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 10 < 7, "development").otherwise("held-out").alias("split"), F.array("source", F.concat(F.lit("len-"), F.least(F.lit(4), F.expr("n_chars div 1000")).cast("string"))).alias("scenarios"),
        F.col("lang").alias("language"), "source", (F.col("doc_id") % 5 + 1).alias("speaker_count"), F.sha2(F.col("text").cast("binary"), 256).alias("media_sha"), "n_chars",
        (F.col("doc_id") % 3 == 0).alias("truth_eligible"), F.when(F.col("doc_id") % 4 != 0, (F.col("n_chars") % 97) / 97.0).alias("wer"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("recording_id").orderBy("ts", "event_id")
    return e.withColumn("recording_id", F.date_format("ts", "yyyy-MM-dd")).select("recording_id", F.row_number().over(w).cast("long").alias("frame_no"), (F.col("value") - 100).alias("rms_db"), (F.col("value") * 10).alias("centroid"), (F.col("value") / 1000).alias("zcr"))


def stage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("stage"), F.col("value").alias("latency_ms"), F.col("user_id").alias("job_id"), (F.col("event_id") % 3 == 0).alias("cache_hit"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "critical").when(F.col("toxic") == 1, "major").when(F.col("quality") == 0, "minor").otherwise("none")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"), F.expr("doc_id div 4").alias("case_id"), F.concat(F.lit("m"), (F.col("doc_id") % 4).cast("string")).alias("alias"), severity.alias("severity"), (F.col("doc_id") % 3 == 0).alias("preferred"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("domain"), F.expr("doc_id div 4").alias("group_id"), F.col("doc_id").alias("candidate_id"), (F.col("doc_id") % 5 != 0).alias("eligible"), (F.col("doc_id") % 4 == 0).alias("current"), F.round((F.col("n_chars") % 101) / 101.0, 9).alias("score"))


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against itself with every 7th word left out and every 11th doubled."""
    documents = table(spark, sf_dir, "documents")
    d = documents.select("doc_id", "lang", F.split(F.regexp_replace("text", "\n", " "), " ").alias("w"))
    edited = F.expr("flatten(transform(filter(transform(w, (x, i) -> struct(x AS x, i + 1 AS i)), s -> s.i % 7 <> 0), s -> if(s.i % 11 = 0, array(s.x, s.x), array(s.x))))")
    return d.select("doc_id", "lang", F.col("w").alias("ref_words"), edited.alias("hyp_words"), F.array_join("w", " ").alias("ref_text"), F.array_join(edited, " ").alias("hyp_text"))


def _shift_sql(drop: int, relabel: int, step: int) -> str:
    nexts = " ".join(f"WHEN '{s}' THEN '{SPEAKERS[(k + 1) % len(SPEAKERS)]}'" for k, s in enumerate(SPEAKERS))
    move = f"(event_id % 7 - 3) * {step}"
    return f"""SELECT event_id, recording_id, speaker_id, s AS start_ms, e AS end_ms FROM (SELECT event_id, recording_id,
        CASE WHEN event_id % {relabel} = 0 THEN CASE speaker_id {nexts} END ELSE speaker_id END AS speaker_id,
        least(greatest(start_ms + {move}, 0), {DAY_MS}) AS s, least(greatest(end_ms + {move}, 0), {DAY_MS}) AS e
        FROM turns_ref WHERE event_id % {drop} <> 0) WHERE e > s"""


#: DuckDB: name to (tables it needs, SQL).
_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "turns_ref": ((), f"""SELECT event_id, recording_id, event_type AS speaker_id, s AS start_ms, least(s + d, {DAY_MS}) AS end_ms FROM (
        SELECT event_id, strftime(ts, '%Y-%m-%d') AS recording_id, event_type, date_diff('millisecond', date_trunc('day', ts), ts) AS s, CAST(floor(value * 10000) AS BIGINT) AS d FROM events) WHERE least(s + d, {DAY_MS}) > s"""),
    "turns_hyp": (("turns_ref",), _shift_sql(11, 13, 15000)),
    "turns_by_system": (("turns_ref",), " UNION ALL ".join(f"SELECT *, '{n}' AS system FROM ({_shift_sql(d, r, s)})" for n, d, r, s in SYSTEMS)),
    "segments": ((), """SELECT concat_ws('-', conv_id, turn) AS segment_id, conv_id AS recording_id, turn, role AS speaker_id, start_ms, start_ms + d AS end_ms, text, ((conv_id * 31 + turn * 17) % 100) / 100.0::DOUBLE AS confidence, lang AS language FROM (
        SELECT *, CAST(coalesce(sum(d) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 80 * turn AS BIGINT) AS start_ms FROM (
        SELECT *, CAST(greatest(900, ceil(length(text) * 1000.0 / 17)) AS BIGINT) AS d FROM conversations)) c LEFT JOIN (SELECT doc_id, lang FROM documents) l ON c.conv_id % 1000 = l.doc_id"""),
    "trials": ((), """SELECT l.vec_id AS l, r.vec_id AS r, l.label AS l_label, r.label AS r_label, l.label = r.label AS same,
        round(greatest(-1, least(1, list_dot_product(l.embedding::DOUBLE[], r.embedding::DOUBLE[]) / (sqrt(list_dot_product(l.embedding::DOUBLE[], l.embedding::DOUBLE[])) * sqrt(list_dot_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]))))), 9) AS score
        FROM embeddings l JOIN embeddings r ON r.vec_id > l.vec_id AND r.vec_id <= l.vec_id + 20"""),
    "eval_cases": ((), """SELECT doc_id AS case_id, CASE WHEN doc_id % 10 < 7 THEN 'development' ELSE 'held-out' END AS split, [source, 'len-' || least(4, n_chars // 1000)] AS scenarios, lang AS language, source, doc_id % 5 + 1 AS speaker_count, sha256(text) AS media_sha, n_chars,
        doc_id % 3 = 0 AS truth_eligible, CASE WHEN doc_id % 4 <> 0 THEN (n_chars % 97) / 97.0::DOUBLE END AS wer FROM documents"""),
    "frames": ((), "SELECT strftime(ts, '%Y-%m-%d') AS recording_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS frame_no, value - 100 AS rms_db, value * 10 AS centroid, value / 1000 AS zcr FROM events"),
    "stage_samples": ((), "SELECT event_id, ts, event_type AS stage, value AS latency_ms, user_id AS job_id, event_id % 3 = 0 AS cache_hit FROM events"),
    "reviews": ((), "SELECT doc_id AS review_id, doc_id // 4 AS case_id, 'm' || (doc_id % 4) AS alias, CASE WHEN quality = 0 AND toxic = 1 THEN 'critical' WHEN toxic = 1 THEN 'major' WHEN quality = 0 THEN 'minor' ELSE 'none' END AS severity, doc_id % 3 = 0 AS preferred FROM labels"),
    "candidates": ((), "SELECT lang AS domain, doc_id // 4 AS group_id, doc_id AS candidate_id, doc_id % 5 <> 0 AS eligible, doc_id % 4 = 0 AS current, round((n_chars % 101) / 101.0::DOUBLE, 9) AS score FROM documents"),
    "doc_pairs": ((), """SELECT doc_id, lang, w AS ref_words, h AS hyp_words, array_to_string(w, ' ') AS ref_text, array_to_string(h, ' ') AS hyp_text FROM (
        SELECT *, flatten(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda s: s[2] % 7 <> 0), lambda s: CASE WHEN s[2] % 11 = 0 THEN [s[1], s[1]] ELSE [s[1]] END)) AS h FROM (
        SELECT doc_id, lang, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents))"""),
}


def with_tables(names: str, body: str) -> str:
    """body after WITH clauses for the named tables (and those they need)."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            for x in _SQL[name][0]:
                add(x)
            done[name] = _SQL[name][1]

    for name in names.split():
        add(name)
    head = ", ".join(f"{k} AS ({v})" for k, v in done.items())
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
