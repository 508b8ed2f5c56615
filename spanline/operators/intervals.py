"""Operators on half-open intervals [start_ms, end_ms): merging, sweeping, overlap joins, nearest points.

Overlap joins are equi-joins on a time bucket: each interval is repeated for the buckets it touches, and a pair counts only in
the bucket where its common part begins, so it counts once and no recording meets itself as a whole. Sweeps turn
intervals into +1/-1 events and keep running sums, O(n log n) in all. Windows are by recording (and speaker); a recording is
the unit that one task must be able to sort, with spilling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], gap: int = 0, strict: bool = False) -> DataFrame:
    """df with a column `island`: rows of one key that touch or lie within `gap` ms of what came before share a number. strict: touching is not enough."""
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("start_ms") >= before + gap) if strict else (F.col("start_ms") > before + gap)
    return df.withColumn("__new", F.when(before.isNull() | apart, 1).otherwise(0)).withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_turns(turns: DataFrame, gap: int = 0, keys: tuple[str, ...] = ("recording_id", "speaker_id")) -> DataFrame:
    """One row for each run of touching or near turns of one speaker, with how many turns went in."""
    return islands(turns, list(keys), gap).groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_turns")).drop("island")


def merge_regions(regions: DataFrame, gap: int = 0, least: int = 0, last: int | None = None) -> DataFrame:
    """Regions of a recording, cut at `last`, merged over gaps, short ones dropped."""
    if last is not None:
        regions = regions.withColumn("end_ms", F.least("end_ms", F.lit(last)))
    merged = merge_turns(regions.where("end_ms > start_ms"), gap, ("recording_id",))
    return merged.where(F.col("end_ms") - F.col("start_ms") >= least)


def overlap_join(left: DataFrame, right: DataFrame, bucket_ms: int = 600_000, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Pairs of overlapping intervals with equal keys: left's columns, right's with the prefix r_, and overlap_ms."""
    cell = lambda c: F.floor(F.col(c) / bucket_ms).cast("long")
    spread = lambda df, s, e: df.withColumn("__cell", F.explode(F.sequence(cell(s), F.floor((F.col(e) - 1) / bucket_ms).cast("long"))))
    r = right.where("end_ms > start_ms").select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns])
    pairs = spread(left.where("end_ms > start_ms"), "start_ms", "end_ms").join(spread(r, "r_start_ms", "r_end_ms"), [*keys, "__cell"])
    start = F.greatest("start_ms", "r_start_ms")
    pairs = pairs.where((F.col("start_ms") < F.col("r_end_ms")) & (F.col("r_start_ms") < F.col("end_ms")) & (F.floor(start / bucket_ms) == F.col("__cell")))
    return pairs.withColumn("overlap_ms", F.least("end_ms", "r_end_ms") - start).drop("__cell")


def overlap_matrix(ref: DataFrame, hyp: DataFrame, bucket_ms: int = 600_000) -> DataFrame:
    """(recording_id, ref_speaker, hyp_speaker, overlap_ms) of merged turns."""
    pairs = overlap_join(merge_turns(ref), merge_turns(hyp), bucket_ms)
    return pairs.groupBy("recording_id", F.col("speaker_id").alias("ref_speaker"), F.col("r_speaker_id").alias("hyp_speaker")).agg(F.sum("overlap_ms").alias("overlap_ms"))


def edges(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """A +1 row at each start and a -1 row at each end, as `t` and `step`."""
    both = F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("step")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("step")))
    return df.select(*keys, *values, F.explode(both).alias("__e")).select(*keys, *values, "__e.t", "__e.step")


def common_time(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """(recording_id, kind, common_ms, equal_ms): the common time of all pairs of a left and a right turn, by the left one's kind, and of those of equal kinds. Running numbers of active turns; no pairs."""
    kinds = left.select("recording_id", kind).distinct()
    l = edges(left, ["recording_id", kind]).select("recording_id", kind, "t", F.col("step").alias("l"), F.lit(0).alias("r"), F.lit(0).alias("same"))
    sums = edges(right, ["recording_id"], kind).groupBy("recording_id", F.col(kind).alias("__kind"), "t").agg(F.sum("step").alias("step")).join(kinds, "recording_id")
    r = sums.select("recording_id", kind, "t", F.lit(0).alias("l"), F.col("step").alias("r"), F.when(F.col("__kind") == F.col(kind), F.col("step")).otherwise(0).alias("same"))
    order = Window.partitionBy("recording_id", kind).orderBy("t")
    up = order.rowsBetween(Window.unboundedPreceding, 0)  # rows of one time have no length between them
    spans = l.unionByName(r).select("recording_id", kind, (F.lead("t").over(order) - F.col("t")).alias("ms"), *[F.sum(c).over(up).alias(c) for c in ("l", "r", "same")])
    return spans.where("ms > 0 AND l > 0 AND r > 0").groupBy("recording_id", kind).agg(F.sum(F.expr("ms * l * r")).alias("common_ms"), F.sum(F.expr("ms * l * same")).alias("equal_ms"))


def active_counts(turns: DataFrame, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Elementary intervals with the number of active turns: (keys, start_ms, end_ms, active)."""
    steps = edges(turns, list(keys)).groupBy(*keys, "t").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(*keys).orderBy("t")
    return steps.select(*keys, F.col("t").alias("start_ms"), F.lead("t").over(order).alias("end_ms"), F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("active")).where("end_ms > start_ms")


def solo_spans(turns: DataFrame) -> DataFrame:
    """Spans where exactly one speaker is active, neighbours of one speaker joined. The speaker comes from a running sum of +-codes."""
    merged = merge_turns(turns)
    names = merged.select("recording_id", "speaker_id").distinct()
    coded = names.withColumn("code", F.dense_rank().over(Window.partitionBy("recording_id").orderBy("speaker_id")))
    steps = edges(merged.join(coded, ["recording_id", "speaker_id"]), ["recording_id"], "code")
    sums = steps.groupBy("recording_id", "t").agg(F.sum("step").alias("step"), F.sum(F.col("step") * F.col("code")).alias("codes"))
    order = Window.partitionBy("recording_id").orderBy("t")
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    solo = sums.select("recording_id", F.col("t").alias("start_ms"), F.lead("t").over(order).alias("end_ms"), F.sum("step").over(up).alias("active"), F.sum("codes").over(up).alias("code")).where("active = 1 AND end_ms > start_ms")
    named = solo.join(coded, ["recording_id", "code"]).select("recording_id", "speaker_id", "start_ms", "end_ms")
    return merge_turns(named).drop("n_turns")


def overlap_regions(turns: DataFrame, bucket_ms: int = 600_000) -> DataFrame:
    """Regions with two or more active speakers and the exact set of them; neighbours with an equal set joined."""
    merged = merge_turns(turns)
    busy = active_counts(merged).where("active >= 2")
    sets = overlap_join(busy.select("recording_id", "start_ms", "end_ms"), merged.drop("n_turns"), bucket_ms).groupBy("recording_id", "start_ms", "end_ms").agg(F.array_join(F.array_sort(F.collect_set("r_speaker_id")), "+").alias("speakers"))
    order = Window.partitionBy("recording_id").orderBy("start_ms")
    new = (F.lag("end_ms").over(order) != F.col("start_ms")) | (F.lag("speakers").over(order) != F.col("speakers"))
    run = sets.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order))
    return run.groupBy("recording_id", "run", "speakers").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("run")


def overlap_flags(turns: DataFrame) -> DataFrame:
    """turns with `overlapped`: whether any other turn of the recording overlaps."""
    order = Window.partitionBy("recording_id").orderBy("start_ms", "end_ms", "event_id")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("start_ms").over(order)  # the least of all later starts
    return turns.withColumn("overlapped", F.coalesce(before > F.col("start_ms"), F.lit(False)) | F.coalesce(after < F.col("end_ms"), F.lit(False)))


def clip(turns: DataFrame, start: int, end: int) -> DataFrame:
    """The part of the turns in [start, end), on the window's own time."""
    inside = turns.where((F.col("start_ms") < end) & (F.col("end_ms") > start))
    return inside.withColumn("start_ms", F.greatest("start_ms", F.lit(start)) - start).withColumn("end_ms", F.least("end_ms", F.lit(end)) - start)


def boundaries(turns: DataFrame, duration: int | None = None) -> DataFrame:
    """The distinct starts and ends of turns, without the recording's own bounds."""
    out = turns.select("recording_id", F.explode(F.array("start_ms", "end_ms")).alias("t")).distinct()
    return out.where((F.col("t") > 0) & (F.col("t") < duration)) if duration else out


def nearest(points: DataFrame, others: DataFrame, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """points with `distance` to the nearest of others (before or after), null if there is none. One union and two running fills; no pairs."""
    both = points.withColumn("__o", F.lit(None).cast("long")).unionByName(others.select(*points.columns).withColumn("__o", F.col("t").cast("long")))
    order = Window.partitionBy(*keys).orderBy("t", F.col("__o").isNull())
    before = F.last("__o", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__o", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("distance", F.least(F.col("t") - before, after - F.col("t"))).where("__o IS NULL").drop("__o")


def sliding_windows(spans: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of `size` every `step` in each span, the last one ending with the span; spans shorter than a window give none."""
    fits = spans.where(F.col("end_ms") - F.col("start_ms") >= size)
    last = F.col("end_ms") - size
    starts = F.array_distinct(F.concat(F.sequence(F.col("start_ms"), last, F.lit(step).cast("long")), F.array(last)))
    return fits.select(*[c for c in spans.columns if c not in ("start_ms", "end_ms")], F.explode(starts).alias("start_ms")).withColumn("end_ms", F.col("start_ms") + size)
