"""Deterministic selection: seeded orders, even and stratified samples, budgets, windows, splits, and rule predicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .diarization import best_assignment
from .scoring import seeded_order


def top_candidates(scores: DataFrame, keys: list[str], k: int, forced: Column) -> DataFrame:
    """The k best rows of each key, and always the forced one."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "candidate_id")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where((F.col("rank") <= k) | forced)


def within_budget(rows: DataFrame, keys: list[str], order: list[Column | str], fraction: float) -> DataFrame:
    """The first floor(fraction * n) rows of each key."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("__k", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.floor(F.lit(fraction) * F.count("*").over(w))).where("__k <= __n").drop("__k", "__n")


def even_sample(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k rows of each key, evenly spaced in order, first and last included; all rows if there are no more than k."""
    w = Window.partitionBy(*keys)
    n = rows.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("__n") - 1) / (k - 1)).cast("int"))
    return n.where((F.col("__n") <= k) | F.array_contains(places, F.col("__i"))).drop("__i", "__n")


def stratified_allocation(rows: DataFrame, stratum: str, total: int) -> DataFrame:
    """Places per stratum: one each, the others to the greatest n / (places + 1), by the highest quotients."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    seats = counts.select(stratum, "n", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(total)).cast("int"))).alias("j"))
    first = F.when(F.col("j") == 1, 0).otherwise(1)
    picked = seats.orderBy(first, F.desc(F.col("n") / F.col("j")), stratum, "j").limit(total)
    return picked.groupBy(stratum).agg(F.count("*").alias("places"), F.max("n").alias("n"))


def disjoint_split(rows: DataFrame, who: str, least: int, seed: str) -> DataFrame:
    """Speakers with at least so many clips, in seeded order, dealt in turn to two splits."""
    enough = rows.groupBy(who).agg(F.count("*").alias("n_clips")).where(F.col("n_clips") >= least)
    k = F.row_number().over(Window.orderBy(seeded_order(seed, who)))  # one row a speaker
    return enough.withColumn("split", F.when(k % 2 == 1, "development").otherwise("held-out"))


def resample(rows: DataFrame, keys: list[str], order: Column, locked: Column) -> DataFrame:
    """ceil(80 %) of each key: locked rows first, then by seeded order."""
    w = Window.partitionBy(*keys)
    k = F.row_number().over(w.orderBy(F.when(locked, 0).otherwise(1), order))
    return rows.withColumn("__k", k).withColumn("__n", F.ceil(F.count("*").over(w) * 4 / 5)).where("__k <= __n").drop("__k", "__n")


def time_split(segments: DataFrame, ratio: float) -> DataFrame:
    """development while the middle of a segment lies before `ratio` of its recording."""
    whole = F.max("end_ms").over(Window.partitionBy("recording_id"))
    return segments.withColumn("split", F.when((F.col("start_ms") + F.col("end_ms")) / 2 < whole * ratio, "development").otherwise("held-out"))


def unique_first(rows: DataFrame, keys: list[str], text: str, order: str, limit: int) -> DataFrame:
    """The first `limit` different strings of a key, case and outer spaces aside, in order of first place."""
    clean = F.lower(F.trim(text))
    first = rows.where(clean != "").groupBy(*keys, clean.alias("__c")).agg(F.min(F.struct(order, text)).alias("x"))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(f"x.{order}"))
    return first.withColumn("place", k.cast("long")).where(F.col("place") <= limit).select(*keys, "place", F.col(f"x.{order}").alias(order))


def selected(cases: DataFrame, split: str | None = None, languages: list[str] | None = None, scenarios: list[str] | None = None, counts: list[int] | None = None) -> DataFrame:
    """Cases that a selector matches; a missing part of it matches all."""
    keep = F.lit(True)
    if split is not None:
        keep = keep & (F.col("split") == split)
    if languages is not None:
        keep = keep & F.col("language").isin(languages)
    if scenarios is not None:
        keep = keep & F.arrays_overlap("scenarios", F.array(*map(F.lit, scenarios)))
    if counts is not None:
        keep = keep & F.col("speaker_count").isin(counts)
    return cases.where(keep)


def case_features(cases: DataFrame) -> Column:
    """Tags of a case: source, length, language, speakers and eligibility."""
    bucket = F.when(F.col("speaker_count") <= 1, "one").when(F.col("speaker_count") <= 3, "few").otherwise("many")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    tags = F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("language:"), "language"), F.concat(F.lit("speakers:"), bucket), F.concat(F.lit("size:"), size), F.when(F.col("truth_eligible"), "truth:yes").otherwise("truth:no"))
    return F.array_union(tags, F.transform("scenarios", lambda s: F.concat(F.lit("scenario:"), s)))


def acceptance(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Long metrics (case_id, metric, value) against rules (metric, op, threshold): a missing metric fails."""
    cases = metrics.select("case_id").distinct()
    due = cases.crossJoin(F.broadcast(rules)).join(metrics, ["case_id", "metric"], "left")
    v, t = F.col("value"), F.col("threshold")
    ok = F.when(F.col("op") == "lte", v <= t).when(F.col("op") == "gte", v >= t).when(F.col("op") == "eq", v == t)
    return due.groupBy("case_id").agg(F.count("*").alias("n_rules"), F.count_if(F.coalesce(ok, F.lit(False))).alias("n_passed"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("accepted"))


def coverage(cases: DataFrame, required: int) -> DataFrame:
    """Counts by dimension (scenario, language, source, number of speakers), bucket and split, the splits below the required count, and why: MISSING without any case, else SHORT_OF and how many are lacking in all."""
    buckets = F.array_union(F.transform("scenarios", lambda x: F.struct(F.lit("scenario").alias("dimension"), x.alias("bucket"))), F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("bucket")) for d, c in (("language", "language"), ("source", "source"), ("speakers", "speaker_count"))]))
    one = cases.select(F.explode(buckets).alias("b"), "split").select("b.dimension", "b.bucket", "split")
    splits = ("development", "held-out")
    wide = one.groupBy("dimension", "bucket").agg(*[F.count_if(F.col("split") == s).alias(s) for s in splits])
    gaps = F.array_compact(F.array(*[F.when(F.col(f"`{s}`") < required, s) for s in splits]))
    lacking = sum(F.greatest(F.lit(0), required - F.col(f"`{s}`")) for s in splits)
    reason = F.when(F.size(gaps) == 0, "").when(F.least(*[F.col(f"`{s}`") for s in splits]) == 0, "MISSING").otherwise(F.concat(F.lit("SHORT_OF:"), lacking.cast("string")))
    return wide.select("dimension", "bucket", F.col("development").alias("n_development"), F.col("`held-out`").alias("n_held_out"), F.array_join(gaps, ",").alias("gaps"), reason.alias("reason"))


def leaked(cases: DataFrame) -> DataFrame:
    """Media in more than one split."""
    return cases.groupBy("media_sha").agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n_cases")).where("n_splits > 1")


def language_vote(rows: DataFrame, keys: list[str], weight: str, ratio: float = 0.8, margin: float = 0.2) -> DataFrame:
    """The weighted majority language; `mul` without a clear one, `und` without weight."""
    votes = rows.groupBy(*keys, "language").agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.desc("w"), "language")
    top = votes.select(*keys, "language", "w", F.row_number().over(order).alias("k"), F.lead("w", 1, 0).over(order).alias("next"), F.sum("w").over(w).alias("all")).where("k = 1")
    share = F.col("w") / F.col("all")
    verdict = F.when(F.col("all") <= 0, "und").when((share >= ratio) | ((F.col("w") - F.col("next")) / F.col("all") >= margin), F.col("language")).otherwise("mul")
    return top.select(*keys, verdict.alias("language"), F.round(share, 9).alias("share"))


def partition_agreement(pairs: DataFrame) -> DataFrame:
    """Adjusted Rand index, pairwise Jaccard, share of point pairs treated alike (co-association) and accuracy under the best one-to-one map of labels, of two labelings (columns a and b), from their table of counts."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(two("n")).alias("both"), F.sum("n").alias("total"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias(f"s{c}"))
    matched = cells.groupBy(F.lit(0).alias("all")).applyInPandas(most_matched, "matched long")
    x = both.crossJoin(side("a")).crossJoin(side("b")).crossJoin(matched)  # one row each
    expected = F.col("sa") * F.col("sb") / two("total")
    apart = F.col("sa") + F.col("sb") - 2 * F.col("both")
    return x.select(
        F.round((F.col("both") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected), 9).alias("adjusted_rand"), F.round(F.col("both") / (F.col("sa") + F.col("sb") - F.col("both")), 9).alias("jaccard"),
        F.round(1 - apart / two("total"), 9).alias("coassociation"), F.round(F.col("matched") / F.col("total"), 9).alias("aligned_accuracy"),
    )


def most_matched(cells: pd.DataFrame) -> pd.DataFrame:
    """The most points that a one-to-one map of the labels brings together, from a table with a row a pair of labels."""
    table = cells.pivot_table(index="a", columns="b", values="n", fill_value=0)
    return pd.DataFrame({"matched": [int(sum(table.iat[i, j] for i, j in best_assignment(table.to_numpy().tolist())))]})


def bare(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


#: Bits of the filter of fragment hashes; 16 MB, whatever the number of fragments.
FILTER_BITS = 1 << 27


def window_hashes(text: str, size: int) -> np.ndarray:
    """A 64-bit hash of every window of `size` characters, by sums over shifted codes; the upper bits of a multiple, as the lower ones mix less."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype("u8")
    out = np.zeros(max(0, len(codes) - size + 1), dtype="u8")
    for k in range(size):
        out += codes[k : k + len(out)] * np.uint64(pow(1_000_003, size - 1 - k, 1 << 64))
    return out * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)


def leak_scan(private: DataFrame, published: DataFrame, size: int = 16, step: int = 8, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Published rows (id, text) that hold a fragment of a private text (id, text): fragments of `size` characters every `step`, after folding case and marks.

    Fragments' hashes set bits of a filter of fixed size, built by Spark as words or-ed together and broadcast. Windows of published texts are hashed in their row,
    and only those whose bit is set become rows, once a text; these meet the fragments in a join by their text. Where fragments are so many that the filter
    fills, more rows take part in that join, by the same plan.
    """
    own = private.select(F.col("id").alias("private_id"), bare(F.col("text")).alias("t")).where(F.length("t") >= size)
    fragments = own.select("private_id", F.explode(F.expr(f"transform(sequence(1, length(t) - {size - 1}, {step}), i -> substr(t, i, {size}))")).alias("f")).distinct()
    many = published.select(F.col("id").alias("public_id"), bare(F.col("text")).alias("t")).where(F.length("t") >= size)

    def bits(batches):
        for batch in batches:
            hashes = window_hashes("".join(batch.column("f").to_pylist()), size)[::size] % np.uint64(filter_bits)
            yield pa.RecordBatch.from_arrays([pa.array((hashes >> np.uint64(6)).astype("i8")), pa.array((np.uint64(1) << (hashes & np.uint64(63))).view("i8"))], names=["word", "bit"])

    words = fragments.select("f").distinct().mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # filter_bits / 64 rows at most
    table = np.zeros(filter_bits // 64, dtype="u8")
    table[words["word"].to_numpy()] = words["bit"].to_numpy().view("u8")
    table = published.sparkSession.sparkContext.broadcast(table)

    def hits(batches):
        for batch in batches:
            ids, found = [], []
            for k, text in enumerate(batch.column("t").to_pylist()):
                hashes = window_hashes(text, size) % np.uint64(filter_bits)
                at = np.flatnonzero(table.value[hashes >> np.uint64(6)] >> (hashes & np.uint64(63)) & np.uint64(1))
                windows = {text[i : i + size] for i in at.tolist()}
                ids += [k] * len(windows)
                found += windows
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column("public_id").take(pa.array(ids)), pa.array(found)], names=["public_id", "f"])

    kind = dict(many.dtypes)["public_id"]
    return many.mapInArrow(hits, f"public_id {kind}, f string").join(fragments, "f").groupBy("public_id", "private_id").agg(F.count_distinct("f").alias("n_fragments"))


def whole_leaks(private: DataFrame, published: DataFrame) -> DataFrame:
    """Published rows whose whole text is a private one, as it is (exact) or in letters and digits alone (normalized), short ones too."""
    side = lambda df, name: df.select(F.col("id").alias(name), F.col("text").alias(f"{name}_text"), bare(F.col("text")).alias("t")).where("t <> ''")
    both = side(private, "private_id").join(side(published, "public_id"), "t")
    return both.select("public_id", "private_id", F.when(F.col("public_id_text") == F.col("private_id_text"), "exact").otherwise("normalized").alias("kind"))


def seeded_windows(spans: DataFrame, size: int, step: int, count: int, seed: str) -> DataFrame:
    """The first `count` candidate windows of each recording by seeded order."""
    w = Window.partitionBy("recording_id").orderBy(seeded_order(seed, "recording_id", "start_ms"))
    return spans.select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration_ms") - size, F.lit(step).cast("long"))).alias("start_ms")).withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= count)
