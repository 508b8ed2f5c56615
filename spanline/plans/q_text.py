"""Queries on text columns: normal forms, edit measures, scripts, literals, formats, and language votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanline.functions import text as X
from spanline.functions import vectors as V

from .registry import query
from .tables import doc_pairs, segments, table, turns_ref, with_tables

NORM = r"trim(regexp_replace(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
N_OF = "len(regexp_extract_all({t}, '{p}'))"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query(f"SELECT doc_id, sha256({NORM.format(t='text')}) AS norm_sha, length({NORM.format(t='text')}) AS norm_length FROM documents")
def h1_normalized(spark, sf):
    n = X.normalized("text")
    return docs(spark, sf).select("doc_id", F.sha2(n.cast("binary"), 256).alias("norm_sha"), F.length(n).cast("long").alias("norm_length"))


@query()
def h1_nfkc(spark, sf):
    """Compatibility form with case folding, by Arrow batches."""
    return docs(spark, sf).select("doc_id", F.sha2(X.normalized("text", latin_only=False).cast("binary"), 256).alias("norm_sha"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_tokens FROM documents")
def h2_score_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.score_tokens("text")).cast("long").alias("n_tokens"))


@query()
def h3_edit_distance(spark, sf):
    return doc_pairs(spark, sf).select("doc_id", X.edit_distance("ref_text", "hyp_text").cast("long").alias("distance"))


@query()
def h3_token_distance(spark, sf):
    return doc_pairs(spark, sf).select("doc_id", X.token_distance("ref_words", "hyp_words").alias("distance"), F.size("ref_words").alias("n_words"))


@query()
def h4_error_rate(spark, sf):
    d = X.edit_distance("ref_text", "hyp_text")
    return doc_pairs(spark, sf).select("doc_id", X.error_rate(d, F.length("ref_text")).alias("cer"), F.when(d == 0, "tied").otherwise("worsened").alias("label"))


@query()
def h5_normalized_distance(spark, sf):
    return doc_pairs(spark, sf).select("doc_id", X.error_rate(X.edit_distance("ref_text", "hyp_text"), F.greatest(F.length("ref_text"), F.length("hyp_text"))).alias("distance"))


@query(with_tables("doc_pairs", "WITH a AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(ref_text, '')) AS c FROM doc_pairs) WHERE c > '~' GROUP BY 1, 2), b AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(hyp_text, '')) AS c FROM doc_pairs) WHERE c > '~' GROUP BY 1, 2) SELECT doc_id, round(sum(least(a.n, coalesce(b.n, 0)))::DOUBLE / sum(a.n), 9) AS retention FROM a LEFT JOIN b USING (doc_id, c) GROUP BY 1"))
def h6_letter_retention(spark, sf):
    """Share of the letters beyond ASCII, as a multiset, that the edited text keeps."""
    def counts(side, name):
        return doc_pairs(spark, sf).select("doc_id", F.explode(F.split(side, "")).alias("c")).where("c > '~'").groupBy("doc_id", "c").agg(F.count("*").alias(name))

    both = counts("ref_text", "a").join(counts("hyp_text", "b"), ["doc_id", "c"], "left")
    return both.groupBy("doc_id").agg(F.round(F.sum(F.least("a", F.coalesce("b", F.lit(0)))) / F.sum("a"), 9).alias("retention"))


#: Words of any letters that consist of capitals or digits alone: word bounds are those of all scripts.
PROT = r"list_sort(list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{Nd}}_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,6}}|[0-9]+')))"


@query(with_tables("doc_pairs", f"SELECT doc_id, {PROT.format(t='ref_text')} = {PROT.format(t='hyp_text')} AS kept FROM doc_pairs"))
def h7_protected_tokens(spark, sf):
    return doc_pairs(spark, sf).select("doc_id", X.protected_kept("ref_text", "hyp_text").alias("kept"))


FOUND = {k: f"regexp_extract_all(text, '{p}')" for k, p in X.LITERALS.items()} | {"acronym": r"list_filter(regexp_extract_all(text, '[\p{L}\p{Nd}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,6}'))"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, literal, count(*) AS n FROM (SELECT unnest({FOUND[k]}) AS literal FROM documents) GROUP BY ALL" for k in ("url", "email", "version", "acronym")))
def h8_literal_inventory(spark, sf):
    found = None
    for kind in ("url", "email", "version", "acronym"):
        own = docs(spark, sf).select(F.lit(kind).alias("kind"), F.explode(X.literals("text", kind)).alias("literal"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy("kind", "literal").agg(F.count("*").alias("n"))


DUCK_SCRIPTS = {"latin": r"\p{Latin}", "han": r"\p{Han}", "kana": r"[\p{Hiragana}\p{Katakana}]", "hangul": r"\p{Hangul}", "cyrillic": r"\p{Cyrillic}", "arabic": r"\p{Arabic}", "digit": r"\p{Nd}"}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in DUCK_SCRIPTS.items()) + " FROM documents")
def h9_script_profile(spark, sf):
    return docs(spark, sf).select("doc_id", *X.script_counts("text"))


MARK_N = {k: f"len(regexp_extract_all(text, '{p}'))" for k, p in X.MARKS.items()}
MOST = f"greatest({', '.join(MARK_N.values())})"
DETECT = f"CASE WHEN len(regexp_extract_all(text, '\\p{{Latin}}')) < length(text) * 0.5 THEN 'und' WHEN {MOST} < len(regexp_extract_all(text, '\\p{{Latin}}')) * 0.002 THEN 'en' " + " ".join(f"WHEN {n} = {MOST} THEN '{k}'" for k, n in MARK_N.items()) + " END"


@query(f"SELECT lang, {DETECT} AS detected, count(*) AS n FROM documents GROUP BY 1, 2")
def h10_language_rules(spark, sf):
    return docs(spark, sf).select("lang", X.language_by_marks("text").alias("detected")).groupBy("lang", "detected").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, detected, detected <> 'und' AND detected <> lang AS conflict, marks * 1.0::DOUBLE / greatest(chars, 1) > 0.01 AND detected = 'en' AS code_switch FROM (SELECT doc_id, lang, {DETECT} AS detected, {MOST} AS marks, length(text) AS chars FROM documents)")
def h11_language_conflict(spark, sf):
    d = X.language_by_marks("text")
    most = F.greatest(*[F.regexp_count("text", F.lit(p)) for p in X.MARKS.values()])
    return docs(spark, sf).select("doc_id", d.alias("detected"), ((d != "und") & (d != F.col("lang"))).alias("conflict"), ((most / F.greatest(F.length("text"), F.lit(1)) > 0.01) & (d == "en")).alias("code_switch"))


@query(with_tables("doc_pairs", f"SELECT doc_id, {NORM.format(t='ref_text')} = {NORM.format(t='hyp_text')} AS copied FROM doc_pairs"))
def h12_copied_source(spark, sf):
    return doc_pairs(spark, sf).select("doc_id", (X.normalized("ref_text") == X.normalized("hyp_text")).alias("copied"))


def _untranslated_sql() -> str:
    scripts = [k for k in DUCK_SCRIPTS if k != "digit"]
    counts = ", ".join(f"len(regexp_extract_all({t}, '{DUCK_SCRIPTS[k]}')) AS {a}_{k}" for a, t in (("s", "ref_text"), ("o", "out_text")) for k in scripts)
    same = "regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    literal = " OR ".join(f"regexp_matches(ref_text, '{p}')" for p in X.LITERALS.values())
    asked = lambda a: f"CASE target WHEN 'ja' THEN {a}_han + {a}_kana WHEN 'ru' THEN {a}_cyrillic WHEN 'de' THEN {a}_latin END"
    kept = " ".join(f"WHEN s_{k} = most THEN o_{k}" for k in scripts)
    rest = lambda a: f"greatest(0, {a}_letters - ({' + '.join(f'{a}_{k}' for k in scripts)}))"
    return f"""WITH t AS (SELECT doc_id, lang, ref_text, CASE WHEN doc_id % 5 = 0 THEN '« ' || ref_text || ' !»' WHEN doc_id % 5 = 1 THEN '12 - 34' ELSE hyp_text END AS out_text, CASE doc_id % 4 WHEN 0 THEN 'ja' WHEN 1 THEN 'ru' WHEN 2 THEN 'de' ELSE 'xx' END AS target FROM doc_pairs),
      c AS (SELECT *, {counts}, len(regexp_extract_all(ref_text, '\\p{{L}}')) AS s_letters, len(regexp_extract_all(out_text, '\\p{{L}}')) AS o_letters, {same.format(t='ref_text')} = {same.format(t='out_text')} AS same, {literal} AS literal FROM t),
      m AS (SELECT *, greatest({', '.join(f's_{k}' for k in scripts)}, {rest('s')}) AS most FROM c), k AS (SELECT *, CASE {kept} ELSE {rest('o')} END AS kept, {asked('o')} AS asked, {asked('s')} AS had FROM m)
      SELECT doc_id, target, lang <> target AND ((s_letters >= 1 AND o_letters = 0) OR (same AND (s_letters >= 6 OR (s_letters >= 3 AND NOT literal)))
        OR coalesce(most >= 8 AND had < most AND kept >= 8 AND kept >= asked * 4 AND asked < greatest(2, kept // 6), false)) AS untranslated FROM k"""


@query(with_tables("doc_pairs", _untranslated_sql()))
def h12_untranslated(spark, sf):
    """Edited texts taken for translations to Japanese, Russian, German or an unknown language; every fifth is the source between marks (engines differ on capitals), every fifth has no letters."""
    target = F.when(F.col("doc_id") % 4 == 0, "ja").when(F.col("doc_id") % 4 == 1, "ru").when(F.col("doc_id") % 4 == 2, "de").otherwise("xx")
    out = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("« "), "ref_text", F.lit(" !»"))).when(F.col("doc_id") % 5 == 1, "12 - 34").otherwise(F.col("hyp_text"))
    return doc_pairs(spark, sf).select("doc_id", target.alias("target"), X.untranslated("ref_text", out, "lang", target).alias("untranslated"))


@query("SELECT conv_id, turn, n_overlap FROM (SELECT conv_id, turn, coalesce(list_max(list_filter(range(1, least(120, length(prev), length(text)) + 1), lambda n: right(prev, n) = left(text, n))), 0) AS n_overlap FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL)")
def h13_suffix_prefix(spark, sf):
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, sf, "conversations").withColumn("prev", prev).where("prev IS NOT NULL")
    return pairs.select("conv_id", "turn", X.suffix_prefix("prev", "text", least=1).cast("long").alias("n_overlap"))


WORDS = ("the", "und", "les", "que")


@query(f"SELECT lang, round(avg(({' + '.join(f'CASE WHEN contains(text, chr(32) || {chr(39)}{w}{chr(39)} || chr(32)) THEN 1 ELSE 0 END' for w in WORDS)}) / {len(WORDS)}.0::DOUBLE), 9) AS recall, count(*) AS n FROM documents GROUP BY 1")
def h14_literal_recall(spark, sf):
    hits = sum((F.col("text").contains(f" {w} ").cast("int") for w in WORDS[1:]), F.col("text").contains(f" {WORDS[0]} ").cast("int"))
    return docs(spark, sf).groupBy("lang").agg(F.round(F.avg(hits / len(WORDS)), 9).alias("recall"), F.count("*").alias("n"))


@query(with_tables("turns_ref", "SELECT event_id, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS srt, printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS vtt, printf('PT%dH%dM%d.%03dS', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS iso FROM turns_ref"))
def h15_timestamps(spark, sf):
    return turns_ref(spark, sf).select("event_id", X.clock("start_ms").alias("srt"), X.clock("start_ms", ".").alias("vtt"), X.iso_duration("start_ms").alias("iso"))


@query(with_tables("segments", r"SELECT segment_id, length(regexp_replace(text, '\s', '', 'g')) AS units, round(length(regexp_replace(text, '\s', '', 'g')) * 1000.0::DOUBLE / (end_ms - start_ms), 6) AS speed FROM segments"))
def h16_reading_speed(spark, sf):
    u = X.reading_units("text")
    return segments(spark, sf).select("segment_id", u.cast("long").alias("units"), F.round(u * 1000.0 / (F.col("end_ms") - F.col("start_ms")), 6).alias("speed"))


@query(r"SELECT doc_id, length(text) - len(regexp_extract_all(text, '[.,:;''!|]')) * 0.5::DOUBLE AS width FROM documents")
def h17_display_width(spark, sf):
    return docs(spark, sf).select("doc_id", X.display_width("text").alias("width"))


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY 1")
def h18_vector_norms(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(V.norm(v)), 6).alias("mean_norm"))


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e) / len(e)), 6) AS rms, round(20 * log10(greatest(sqrt(list_dot_product(e, e) / len(e)), 1e-10)), 4) AS db, round(len(list_filter(range(2, len(e) + 1), lambda i: (e[i] >= 0) <> (e[i - 1] >= 0)))::DOUBLE / (len(e) - 1), 6) AS zcr FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def h19_frame_features(spark, sf):
    e = F.col("embedding").cast("array<double>")
    rms = F.sqrt(V.dot(e, e) / F.size(e))
    signs = F.zip_with(F.slice(e, 2, 10**6), F.slice(e, F.lit(1), F.size(e) - 1), lambda a, b: ((a >= 0) != (b >= 0)).cast("int"))
    crossings = F.aggregate(signs, F.lit(0), lambda s, x: s + x)
    return table(spark, sf, "embeddings").select("vec_id", F.round(rms, 6).alias("rms"), F.round(20 * F.log10(F.greatest(rms, F.lit(1e-10))), 4).alias("db"), F.round(crossings / (F.size(e) - 1), 6).alias("zcr"))


@query(with_tables("doc_pairs", "WITH p AS (SELECT doc_id, len(ref_words) AS n, list_filter(range(1, len(ref_words) + 1), lambda i: i % 7 = 0 OR i % 11 = 0) AS truth, list_filter(range(1, least(len(ref_words), len(hyp_words)) + 1), lambda i: ref_words[i] <> hyp_words[i]) AS found FROM doc_pairs) SELECT doc_id, len(list_intersect(truth, found)) AS hits, round(CASE WHEN len(found) > 0 THEN len(list_intersect(truth, found))::DOUBLE / len(found) END, 9) AS precision, round(CASE WHEN len(truth) > 0 THEN len(list_intersect(truth, found))::DOUBLE / len(truth) END, 9) AS recall FROM p"))
def h20_edit_spans(spark, sf):
    """Positions that the edit touched against positions whose words differ."""
    p = doc_pairs(spark, sf)
    truth = F.expr("filter(sequence(1, size(ref_words)), i -> i % 7 = 0 OR i % 11 = 0)")
    found = F.expr("filter(sequence(1, least(size(ref_words), size(hyp_words))), i -> i > 0 AND ref_words[i - 1] <> hyp_words[i - 1])")
    own = p.where("size(hyp_words) > 0").select("doc_id", truth.alias("t"), found.alias("f")).unionByName(p.where("size(hyp_words) = 0").select("doc_id", truth.alias("t"), F.array().cast("array<int>").alias("f")))
    hits = F.size(F.array_intersect("t", "f"))
    return own.select("doc_id", hits.cast("long").alias("hits"), X.error_rate(hits, F.size("f")).alias("precision"), X.error_rate(hits, F.size("t")).alias("recall"))


@query(with_tables("segments", r"SELECT segment_id, t <> text AND regexp_replace(t, '[\p{P}\p{S}\s]', '', 'g') = regexp_replace(text, '[\p{P}\p{S}\s]', '', 'g') AS only_marks FROM (SELECT *, replace(text, '.', ';') AS t FROM segments)"))
def h21_punctuation_only(spark, sf):
    return segments(spark, sf).select("segment_id", X.punctuation_only_change("text", F.regexp_replace("text", r"\.", ";")).alias("only_marks"))


@query(with_tables("segments", "SELECT recording_id, string_agg(text, ' ' ORDER BY turn) AS text FROM segments GROUP BY 1"))
def h22_join_pieces(spark, sf):
    """Texts of a recording in order, with a space where a letter of both sides would meet."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    joined = F.aggregate(pieces, F.lit(""), lambda a, x: F.when(a == "", x).when(a.rlike(r"[^\x00-\x7fÀ-ɏ]$") & x.rlike(r"^[^\x00-\x7fÀ-ɏ]"), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x)))
    return segments(spark, sf).groupBy("recording_id").agg(joined.alias("text"))


@query(with_tables("segments", "SELECT segment_id, round(exp(-(start_ms - prev) / 1800.0::DOUBLE), 9) AS decay FROM (SELECT *, lag(end_ms) OVER (PARTITION BY recording_id ORDER BY turn) AS prev FROM segments) WHERE prev IS NOT NULL"))
def h23_gap_decay(spark, sf):
    prev = F.lag("end_ms").over(Window.partitionBy("recording_id").orderBy("turn"))
    return segments(spark, sf).withColumn("prev", prev).where("prev IS NOT NULL").select("segment_id", F.round(F.exp(-(F.col("start_ms") - F.col("prev")) / 1800.0), 9).alias("decay"))


LUM = "0.2126 * {r} + 0.7152 * {g} + 0.0722 * {b}"
LIN = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


@query(f"SELECT event_id, round(({LUM.format(r='255', g='255', b='255').replace('255', '1.0')} + 0.05) / ({LUM.format(r='(' + LIN.format(c='r') + ')', g='(' + LIN.format(c='g') + ')', b='(' + LIN.format(c='b') + ')')} + 0.05), 6) AS contrast FROM (SELECT event_id, event_id % 256 AS r, event_id * 7 % 256 AS g, event_id * 13 % 256 AS b FROM events)")
def h24_contrast(spark, sf):
    """Contrast of white letters on colours taken from event ids."""
    def linear(c):
        x = c / 255.0
        return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    k = F.col("event_id")
    light = 0.2126 * linear(k % 256) + 0.7152 * linear(k * 7 % 256) + 0.0722 * linear(k * 13 % 256)
    return table(spark, sf, "events").select("event_id", F.round(1.05 / (light + 0.05), 6).alias("contrast"))


@query()
def h24_ciede2000(spark, sf):
    """Difference of the same colours from white."""
    from spanline.functions.colour import ciede2000, lab

    k, white = F.col("event_id"), F.lit(255)
    return table(spark, sf, "events").select("event_id", F.round(ciede2000(lab(k % 256, k * 7 % 256, k * 13 % 256), lab(white, white, white)), 6).alias("difference"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', round_even(n / 1024.0::DOUBLE, 1)) WHEN n < 1073741824 THEN printf('%.1f MB', round_even(n / 1048576.0::DOUBLE, 1)) ELSE printf('%.1f GB', round_even(n / 1073741824.0::DOUBLE, 1)) END AS size FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * l_quantity) AS BIGINT) AS n FROM lineitem)")
def h25_human_size(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.human_size(F.floor(F.col("l_extendedprice") * F.col("l_quantity"))).alias("size"))


@query("SELECT lang, CASE WHEN bool_and(cjk) THEN 'character' WHEN bool_or(cjk) THEN 'mixed' ELSE 'word' END AS unit FROM (SELECT lang, regexp_matches(text, '[\\x{3400}-\\x{9fff}]') AS cjk FROM documents) GROUP BY 1")
def h26_scoring_unit(spark, sf):
    cjk = F.col("text").rlike(X.CJK)
    return docs(spark, sf).groupBy("lang").agg(F.when(F.bool_and(cjk), "character").when(F.bool_or(cjk), "mixed").otherwise("word").alias("unit"))


@query(r"SELECT s AS raw, n, CASE WHEN regexp_matches(s, '[0-9]') THEN CAST(CAST(regexp_extract(s, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS VARCHAR) WHEN s <> '' THEN s ELSE '0' END AS speaker FROM (SELECT trim(source) AS s, count(*) AS n FROM documents GROUP BY 1)")
def b3_normalize_speaker(spark, sf):
    return docs(spark, sf).groupBy(F.trim("source").alias("raw")).agg(F.count("*").alias("n")).withColumn("speaker", X.normalize_speaker("raw"))


@query("SELECT lang, n, lower(lang) || '-' || upper(lang) AS tag FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def b4_language_tag(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n")).withColumn("tag", X.language_tag(F.concat(F.upper("lang"), F.lit("_"), F.col("lang"))))


@query(with_tables("segments", "SELECT segment_id, language, n AS next_language, n = 'und' OR split_part(language, '-', 1) = split_part(n, '-', 1) AS agree FROM (SELECT segment_id, language, CASE WHEN turn % 3 = 0 THEN 'und' ELSE lead(language) OVER (PARTITION BY recording_id ORDER BY turn) || '-X' END AS n FROM segments)"))
def b5_languages_agree(spark, sf):
    s = segments(spark, sf)
    nxt = s.select((F.col("recording_id")).alias("rid"), F.col("turn").alias("t"), "language", "segment_id", F.lead("language").over(Window.partitionBy("recording_id").orderBy("turn")).alias("l"))
    n = F.when(F.col("t") % 3 == 0, "und").otherwise(F.concat("l", F.lit("-X")))
    return nxt.select("segment_id", "language", n.alias("next_language")).withColumn("agree", X.languages_agree("language", "next_language"))
