"""Scoring one timeline against another: error rates, speaker maps, overlap and boundary quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import boundaries, edges, merge_turns, nearest, overlap_join
from .scoring import percentiles


def speaking_time(turns: DataFrame) -> DataFrame:
    """Union time, number of runs and share of each speaker."""
    per = merge_turns(turns).withColumn("d", F.col("end_ms") - F.col("start_ms")).groupBy("recording_id", "speaker_id").agg(F.sum("d").alias("speech_ms"), F.count("*").alias("n_runs"), F.max("d").alias("longest_ms"))
    return per.withColumn("share", F.round(F.col("speech_ms") / F.sum("speech_ms").over(Window.partitionBy("recording_id")), 9))


def speech_union(turns: DataFrame) -> DataFrame:
    """Time with any speech, and the number of regions, per recording."""
    return merge_turns(turns, 0, ("recording_id",)).groupBy("recording_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.count("*").alias("n_regions"))


def mutual_best(matrix: DataFrame, least_ratio: float = 0.5, least_ms: int = 1000, margin: float = 0.1) -> DataFrame:
    """Pairs that choose each other, with the reference speaker's overlap share, and its lead over the runner-up."""
    rows = Window.partitionBy("recording_id", "hyp_speaker")
    best = rows.orderBy(F.desc("overlap_ms"), "ref_speaker")
    back = Window.partitionBy("recording_id", "ref_speaker").orderBy(F.desc("overlap_ms"), "hyp_speaker")
    ranked = matrix.select("*", F.row_number().over(best).alias("k"), F.row_number().over(back).alias("back"), F.lead("overlap_ms", 1, 0).over(best).alias("next_ms"), F.sum("overlap_ms").over(rows).alias("all_ms"))
    share = F.col("overlap_ms") / F.col("all_ms")
    kept = (F.col("k") == 1) & (F.col("back") == 1) & (F.col("overlap_ms") >= least_ms) & (share >= least_ratio) & ((F.col("overlap_ms") - F.col("next_ms")) / F.col("all_ms") >= margin)
    return ranked.where(kept).select("recording_id", "hyp_speaker", "ref_speaker", "overlap_ms", F.round(share, 9).alias("ratio"))


def best_assignment(weights: list[list[float]]) -> list[tuple[int, int]]:
    """The one-to-one map of most weight: rows enter one by one along shortest augmenting paths over prices, in time cubic in the speakers. Pairs without weight stay apart."""
    w = np.maximum(np.array(weights, dtype="f8"), 0)
    if not w.size:
        return []
    turned = w.shape[0] > w.shape[1]
    cost = -(w.T if turned else w)
    n, m = cost.shape
    row_price, price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)  # the row that has a column
    for new in range(n):
        # distances to columns from the new row; scanned ones are final
        distance, before, scanned = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, column, reached = new, -1, 0.0
        while True:
            through = reached + cost[row] - row_price[row] - price
            nearer = ~scanned & (through < distance)
            distance[nearer], before[nearer] = through[nearer], column
            column = int(np.where(scanned, np.inf, distance).argmin())
            reached = distance[column]
            scanned[column] = True
            if owner[column] < 0:
                break
            row = owner[column]
        row_price[new] += reached
        inner = np.flatnonzero(scanned & (owner >= 0))
        row_price[owner[inner]] += reached - distance[inner]
        price[scanned] -= reached - distance[scanned]
        while column >= 0:  # shift owners back along the path
            last = before[column]
            owner[column] = new if last < 0 else owner[last]
            column = last
    pairs = [(int(r), c) for c, r in enumerate(owner) if r >= 0 and cost[r, c] < 0]
    return sorted((c, r) if turned else (r, c) for r, c in pairs)


def optimal_map(matrix: DataFrame) -> DataFrame:
    """(recording_id, ref_speaker, hyp_speaker, overlap_ms) of the one-to-one map with most common time; one small table per recording goes to the solver."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        table = part.pivot_table(index="ref_speaker", columns="hyp_speaker", values="overlap_ms", fill_value=0).sort_index().sort_index(axis=1)
        pairs = best_assignment(table.to_numpy().tolist())
        return pd.DataFrame([(part["recording_id"].iloc[0], table.index[r], table.columns[c], int(table.iat[r, c])) for r, c in pairs], columns=["recording_id", "ref_speaker", "hyp_speaker", "overlap_ms"])

    kind = dict(matrix.dtypes)["recording_id"]
    return matrix.groupBy("recording_id").applyInPandas(solve, f"recording_id {kind}, ref_speaker string, hyp_speaker string, overlap_ms long")


def greedy_map(matrix: DataFrame) -> DataFrame:
    """Each reference speaker, in label order, takes the best label still free: a fold over a recording's speakers."""
    rows = matrix.groupBy("recording_id", "ref_speaker").agg(F.array_sort(F.collect_list(F.struct((-F.col("overlap_ms")).alias("o"), F.col("hyp_speaker").alias("h")))).alias("ways"))
    fold = rows.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("ref_speaker", "ways"))).alias("speakers"))
    taken = F.expr("""aggregate(speakers, cast(array() AS array<struct<r: string, h: string, o: bigint>>), (done, s) ->
        concat(done, slice(transform(filter(s.ways, x -> NOT exists(done, d -> d.h = x.h)), x -> struct(s.ref_speaker AS r, x.h AS h, -x.o AS o)), 1, 1)))""")
    return fold.select("recording_id", F.explode(taken).alias("x")).select("recording_id", F.col("x.r").alias("ref_speaker"), F.col("x.h").alias("hyp_speaker"), F.col("x.o").alias("overlap_ms"))


def relabel(hyp: DataFrame, mapping: DataFrame) -> DataFrame:
    """hyp with reference names where the map has one; other labels are marked so that they never equal a reference name."""
    m = mapping.select("recording_id", F.col("hyp_speaker").alias("speaker_id"), F.col("ref_speaker").alias("__to"))
    return hyp.join(m, ["recording_id", "speaker_id"], "left").withColumn("speaker_id", F.coalesce("__to", F.concat(F.lit("~"), "speaker_id"))).drop("__to")


def error_sweep(ref: DataFrame, hyp: DataFrame, bucket_ms: int = 600_000) -> DataFrame:
    """Elementary intervals with r, h and c: active reference, hypothesis and agreeing speakers. hyp carries reference names."""
    r, h = merge_turns(ref), merge_turns(hyp)
    both = overlap_join(r, h, bucket_ms).where("speaker_id = r_speaker_id").select("recording_id", F.greatest("start_ms", "r_start_ms").alias("start_ms"), F.least("end_ms", "r_end_ms").alias("end_ms"))
    parts = [edges(df, ["recording_id"]).select("recording_id", "t", *[(F.col("step") if n == k else F.lit(0)).alias(n) for n in "rhc"]) for k, df in zip("rhc", (r, h, both), strict=True)]
    steps = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("recording_id", "t").agg(*[F.sum(n).alias(n) for n in "rhc"])
    order = Window.partitionBy("recording_id").orderBy("t")
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("recording_id", F.col("t").alias("start_ms"), (F.lead("t").over(order) - F.col("t")).alias("ms"), *[F.sum(n).over(up).alias(n) for n in "rhc"]).where("ms > 0")


def diarization_error(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Missed, false-alarm and confused speaker time, reference time and the error rate of each recording; overlap counts, no collar."""
    s = error_sweep(ref, hyp)
    ms = lambda x: F.sum(F.col("ms") * x)
    zero = F.lit(0)
    out = s.groupBy("recording_id").agg(
        ms(F.greatest(F.col("r") - F.col("h"), zero)).alias("missed_ms"), ms(F.greatest(F.col("h") - F.col("r"), zero)).alias("false_alarm_ms"),
        ms(F.least("r", "h") - F.col("c")).alias("confusion_ms"), ms(F.col("r")).alias("reference_ms"),
    )
    return out.withColumn("der", rate("missed_ms + false_alarm_ms + confusion_ms", "reference_ms"))


def rate(top: str, bottom: str):
    return F.round(F.expr(f"CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) END"), 9)


def corpus_error(cases: DataFrame, split: str = "split") -> DataFrame:
    """Sums of case times, then rates, by split and over all."""
    names = ["missed_ms", "false_alarm_ms", "confusion_ms", "reference_ms"]
    total = cases.groupingSets([[F.col(split)], []], F.col(split)).agg(F.count("*").alias("n_cases"), *[F.sum(n).alias(n) for n in names])
    return total.withColumn(split, F.coalesce(split, F.lit("all"))).withColumn("der", rate("missed_ms + false_alarm_ms + confusion_ms", "reference_ms"))


def jaccard_error(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Mean over reference speakers of 1 - common / union time; a speaker without a match counts 1. hyp carries reference names."""
    r, h = merge_turns(ref), merge_turns(hyp)
    time = lambda df, name: df.groupBy("recording_id", "speaker_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(name))
    common = overlap_join(r, h).where("speaker_id = r_speaker_id").groupBy("recording_id", "speaker_id").agg(F.sum("overlap_ms").alias("common"))
    both = time(r, "a").join(time(h, "b"), ["recording_id", "speaker_id"], "left").join(common, ["recording_id", "speaker_id"], "left").fillna(0, ["b", "common"])
    return both.groupBy("recording_id").agg(F.count("*").alias("n_speakers"), F.round(F.avg(1 - F.col("common") / (F.col("a") + F.col("b") - F.col("common"))), 9).alias("jer"))


def overlap_quality(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Recall, precision and F1 of time with two or more speakers; recall of speaker time inside it."""
    s = error_sweep(ref, hyp)
    ms = lambda c: F.sum(F.when(F.expr(c), F.col("ms")).otherwise(0))
    out = s.groupBy("recording_id").agg(ms("r >= 2").alias("ref_ms"), ms("h >= 2").alias("hyp_ms"), ms("r >= 2 AND h >= 2").alias("both_ms"), F.sum(F.when(F.expr("r >= 2"), F.col("ms") * F.col("c")).otherwise(0)).alias("hit_ms"), F.sum(F.when(F.expr("r >= 2"), F.col("ms") * F.col("r")).otherwise(0)).alias("speaker_ms"))
    return out.select("recording_id", "ref_ms", "hyp_ms", "both_ms", rate("both_ms", "ref_ms").alias("recall"), rate("both_ms", "hyp_ms").alias("precision"), rate("2 * both_ms", "ref_ms + hyp_ms").alias("f1"), rate("hit_ms", "speaker_ms").alias("speaker_recall"))


def boundary_distances(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Every reference boundary with its distance to the nearest hypothesis boundary, and the other way round."""
    r, h = boundaries(merge_turns(ref)), boundaries(merge_turns(hyp))
    return nearest(r, h).withColumn("side", F.lit("ref")).unionByName(nearest(h, r).withColumn("side", F.lit("hyp")))


def boundary_quality(ref: DataFrame, hyp: DataFrame, tolerance: int = 500) -> DataFrame:
    """Recall and precision within a tolerance, and mean, linear p50 and p95 and greatest error of the reference boundaries."""
    d = boundary_distances(ref, hyp)
    side = lambda s: F.when(F.col("side") == s, F.col("distance"))
    near = lambda s: F.count_if((F.col("side") == s) & (F.col("distance") <= tolerance))
    out = d.groupBy("recording_id").agg(
        F.count(side("ref")).alias("n_ref"), F.count(side("hyp")).alias("n_hyp"), near("ref").alias("ref_hits"), near("hyp").alias("hyp_hits"), F.round(F.avg(side("ref")), 6).alias("mean_ms"), F.max(side("ref")).alias("max_ms"),
    )
    middle = percentiles(d.where("side = 'ref'"), ["recording_id"], "distance", {"p50_ms": 0.5, "p95_ms": 0.95})
    out = out.join(middle.select("recording_id", *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms")]), "recording_id", "left").select("recording_id", "n_ref", "n_hyp", "ref_hits", "hyp_hits", "mean_ms", "p50_ms", "p95_ms", "max_ms")
    return out.select("*", rate("ref_hits", "n_ref").alias("recall"), rate("hyp_hits", "n_hyp").alias("precision"), (F.col("n_ref") - F.col("ref_hits")).alias("missed"), (F.col("n_hyp") - F.col("hyp_hits")).alias("spurious"))


def count_accuracy(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Share of recordings with the right number of speakers, and the mean absolute difference."""
    n = lambda df, name: df.groupBy("recording_id").agg(F.count_distinct("speaker_id").alias(name))
    both = n(ref, "a").join(n(hyp, "b"), "recording_id", "full_outer").fillna(0)
    return both.agg(F.count("*").alias("n_recordings"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 9).alias("accuracy"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 9).alias("mean_abs_error"))


def speaker_differences(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Speakers of one side only: missed (reference) and false alarm (hypothesis)."""
    r, h = (df.select("recording_id", "speaker_id").distinct() for df in (ref, hyp))
    keys = ["recording_id", "speaker_id"]
    return r.join(h, keys, "left_anti").withColumn("kind", F.lit("missed")).unionByName(h.join(r, keys, "left_anti").withColumn("kind", F.lit("false_alarm")))


def time_conflicts(turns: DataFrame, tolerance: int = 50) -> DataFrame:
    """Pairs of speakers of a recording that overlap by more than the tolerance in some pair of runs."""
    runs = merge_turns(turns).drop("n_turns")
    pairs = overlap_join(runs, runs).where((F.col("speaker_id") < F.col("r_speaker_id")) & (F.col("overlap_ms") > tolerance))
    return pairs.groupBy("recording_id", "speaker_id", "r_speaker_id").agg(F.count("*").alias("n_conflicts"), F.max("overlap_ms").alias("longest_ms"))


