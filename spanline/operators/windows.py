"""Window operators on ordered rows: runs, islands, gates, smoothing. Rows of one recording are one window.

Where a rule reads what it has itself just changed, a recording's sorted rows go through a small Python step with constant state.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.functions.text import suffix_prefix

from .intervals import islands
from .scoring import percentiles


def speaker_runs(segments: DataFrame, gap: int) -> DataFrame:
    """segments with run, place in it and its size: rows of one speaker in a row, within a gap."""
    order = Window.partitionBy("recording_id").orderBy("start_ms", "segment_id")
    same = (F.lag("speaker_id").over(order) == F.col("speaker_id")) & (F.col("start_ms") - F.lag("end_ms").over(order) <= gap)
    runs = segments.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("__new").over(order)).drop("__new")
    own = Window.partitionBy("recording_id", "run")
    return runs.withColumn("place", F.row_number().over(own.orderBy("start_ms")).cast("long")).withColumn("size", F.count("*").over(own))


def ordered_text(sep: str = " ") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "text"))), lambda x: x["text"]), sep)


def coalesce_runs(segments: DataFrame, gap: int) -> DataFrame:
    return speaker_runs(segments, gap).groupBy("recording_id", "speaker_id", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"), ordered_text().alias("text")).drop("run")


def switch_points(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from that before."""
    return df.withColumn("prev", F.lag(value).over(Window.partitionBy(*keys).orderBy(order))).where(F.col("prev") != F.col(value))


def activity_gate(frames: DataFrame) -> DataFrame:
    """Frames at or above min(p50, p05 + 12 dB) of their recording, and the change of level, centroid and zero crossings from the frame before."""
    gate = percentiles(frames, ["recording_id"], "rms_db", {"middle": 0.5, "floor": 0.05}).select("recording_id", F.least("middle", F.col("floor") + 12).alias("threshold"))
    w = Window.partitionBy("recording_id").orderBy("frame_no")
    change = sum(F.abs(F.col(c) - F.lag(c).over(w)) / size for c, size in (("rms_db", 12.0), ("centroid", 4000.0), ("zcr", 0.2)))
    return frames.join(gate, "recording_id").select("recording_id", "frame_no", (F.col("rms_db") >= F.col("threshold")).alias("active"), F.round(F.coalesce(change, F.lit(0.0)), 6).alias("change"))


def least_runs(frames: DataFrame, speech: int, silence: int) -> DataFrame:
    """Runs of speech or silence below their least length take the other state; runs are those of the input."""
    w = Window.partitionBy("recording_id").orderBy("frame_no")
    new = F.when(F.lag("active").over(w).eqNullSafe(F.col("active")), 0).otherwise(1)
    runs = frames.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    n = F.count("*").over(Window.partitionBy("recording_id", "run"))
    return runs.withColumn("__n", n).select("recording_id", "frame_no", F.when(F.col("active") & (F.col("__n") < speech), False).when(~F.col("active") & (F.col("__n") < silence), True).otherwise(F.col("active")).alias("active"))


def merge_peaks(points: DataFrame, radius: int) -> DataFrame:
    """Chains of points within a radius become their best one, with how many they were."""
    w = Window.partitionBy("recording_id").orderBy("t", "event_id")
    chained = points.withColumn("__new", F.when(F.col("t") - F.lag("t").over(w) <= radius, 0).otherwise(1)).withColumn("grp", F.sum("__new").over(w))
    best = F.min(F.struct((-F.col("score")).alias("s"), "t", "event_id"))
    return chained.groupBy("recording_id", "grp").agg(best.alias("b"), F.count("*").alias("n")).select("recording_id", F.col("b.t").alias("t"), (-F.col("b.s")).alias("score"), "n")


def shift_cues(segments: DataFrame, gap: int) -> DataFrame:
    """Each cue begins no sooner than the one before ends plus the gap: with D the time taken before, start = D + max(start - D) so far."""
    w = Window.partitionBy("recording_id").orderBy("turn")
    before = F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms") + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn("__d", before).withColumn("cue_start", F.col("__d") + F.max(F.col("start_ms") - F.col("__d")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__d")


def canonical_numbers(turns: DataFrame) -> DataFrame:
    """speaker-1, speaker-2, ... by first appearance."""
    first = turns.groupBy("recording_id", "speaker_id").agg(F.min("start_ms").alias("first"))
    n = F.row_number().over(Window.partitionBy("recording_id").orderBy("first", "speaker_id"))
    return first.select("recording_id", "speaker_id", F.concat(F.lit("speaker-"), n.cast("string")).alias("canonical"))


def rms_frames(signal: str, size: int, hop: int) -> Column:
    """Root mean squares of frames of a sample array."""
    starts = F.sequence(F.lit(1), F.size(signal) - size + 1, F.lit(hop))
    return F.transform(starts, lambda i: F.sqrt(F.aggregate(F.slice(F.col(signal), i, F.lit(size)), F.lit(0.0), lambda a, x: a + x * x) / size))


def valleys(frames: DataFrame, depth: float) -> DataFrame:
    """Local energy minima of at least a relative depth."""
    w = Window.partitionBy("recording_id").orderBy("frame_no")
    f = frames.withColumn("l", F.lag("rms_db").over(w)).withColumn("r", F.lead("rms_db").over(w))
    low = F.least("l", "r")
    d = (low - F.col("rms_db")) / F.greatest(F.abs(low), F.lit(1e-9))
    return f.where("rms_db <= l AND rms_db < r").withColumn("d", d).where(F.col("d") >= depth).select("recording_id", "frame_no", F.round("d", 6).alias("depth"))


def expand_window(turns: DataFrame, start: int, end: int) -> DataFrame:
    """The smallest window around [start, end) that cuts no turn: the island of strictly overlapping turns and the window."""
    span = ["recording_id", "start_ms", "end_ms"]
    own = turns.select("recording_id").distinct().select("recording_id", F.lit(start).cast("long").alias("start_ms"), F.lit(end).cast("long").alias("end_ms"))
    isles = islands(turns.select(*span).unionByName(own), ["recording_id"], strict=True).groupBy("recording_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return isles.where((F.col("start_ms") <= start) & (F.col("end_ms") >= end)).drop("island")


def speaker_windows(starts: DataFrame, turns: DataFrame, size: int, least: int = 1, bucket_ms: int = 3_600_000) -> DataFrame:
    """(recording_id, start_ms, n, least_ms, speech_ms): for each window of `size` from a start (start_ms), how many speakers have turns of `least` ms or more in it, the least of their times and the sum.

    A speaker's time up to a moment follows from the sums of starts and ends before it, so a window is a difference and never meets its turns. Windows go by the time bucket of their
    start, with the parts of turns in their reach.
    """
    cell = lambda c: F.floor(c / bucket_ms).cast("long")
    s, e, kind = F.col("start_ms"), F.col("end_ms"), dict(turns.dtypes)["recording_id"]
    asked = starts.select("recording_id", cell(s).alias("cell"), "start_ms", F.lit(None).cast("long").alias("end_ms"), F.lit(None).cast("string").alias("speaker_id")).distinct()
    spread = turns.where("end_ms > start_ms").select("recording_id", F.explode(F.sequence(cell(s - size), cell(e))).alias("cell"), "start_ms", "end_ms", "speaker_id")

    def count(part: pd.DataFrame) -> pd.DataFrame:
        own = part["end_ms"].isna()
        at = part.loc[own, "start_ms"].to_numpy()
        n, shortest, total = (np.zeros(len(at), dtype="i8") for _ in range(3))
        for _, rows in part[~own].groupby("speaker_id", dropna=False) if len(at) else ():
            sides = [np.sort(rows[c].to_numpy(dtype="i8")) for c in ("start_ms", "end_ms")]
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in sides]

            def upto(t: np.ndarray) -> np.ndarray:
                (k, begun), (j, ended) = ((k, x[k]) for x, k in ((x, np.searchsorted(v, t)) for v, x in zip(sides, sums, strict=True)))
                return (k - j) * t - begun + ended

            ms = upto(at + size) - upto(at)
            speaks = ms >= max(least, 1)
            shortest = np.where(speaks & ((n == 0) | (ms < shortest)), ms, shortest)
            n += speaks
            total += np.where(speaks, ms, 0)
        out = pd.DataFrame({"recording_id": part["recording_id"].iloc[0], "start_ms": at, "n": n, "least_ms": shortest, "speech_ms": total})
        return out[n > 0]

    return asked.unionByName(spread).groupBy("recording_id", "cell").applyInPandas(count, f"recording_id {kind}, start_ms long, n long, least_ms long, speech_ms long")


def stage_stats(samples: DataFrame) -> DataFrame:
    sums = samples.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("latency_ms"), 4).alias("total_ms"), F.max("latency_ms").alias("peak"), F.round(F.avg(F.col("cache_hit").cast("int")), 9).alias("hit_rate"))
    middle = percentiles(samples, ["stage"], "latency_ms", {"p50": 0.5, "p95": 0.95})
    return sums.join(middle, "stage", "left").select("stage", "n", "total_ms", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "peak", "hit_rate")


def repair_islands(segments: DataFrame, most: int, gap: int, strong: float) -> DataFrame:
    """segments with `fixed`, `verdict` and `blockers`: a short segment between two of one other speaker takes that speaker, where nothing speaks against it.

    segments: (recording_id, segment_id, start_ms, end_ms, speaker_id, margin, locked, overlapping, boundary_conflict, top: the two best speakers). Neighbours are read as they came. A margin of
    `strong` or more keeps its speaker (STRONG); any blocker leaves it for review (REVIEW). A speaker's last segment is never given away: that is counted through a recording's open
    islands in order of time, as each change takes from one speaker and gives to another. Only islands without another blocker go through that count.
    """
    w = Window.partitionBy("recording_id").orderBy("start_ms", "end_ms", "segment_id")
    before = lambda c: F.lag(c).over(w)
    after = lambda c: F.lead(c).over(w)
    speaker = F.col("speaker_id")
    rows = segments.select("*", before("speaker_id").alias("target"), F.coalesce((before("speaker_id") == after("speaker_id")) & (speaker != before("speaker_id")), F.lit(False)).alias("island"), F.row_number().over(w).alias("place"), *[
        f(c).alias(f"{name}_{c}") for name, f in (("left", before), ("right", after)) for c in ("start_ms", "end_ms", "overlapping")
    ])
    next_to = F.coalesce(F.lag("island").over(w), F.lit(False)) | F.coalesce(F.lead("island").over(w), F.lit(False))
    apart = lambda a, b: F.greatest(F.lit(0), F.col(b) - F.col(a))
    checks = {
        "DURATION": F.col("end_ms") - F.col("start_ms") > most, "OVERLAP": (F.col("left_end_ms") > F.col("start_ms")) | (F.col("end_ms") > F.col("right_start_ms")),
        "GAP": F.greatest(apart("left_end_ms", "start_ms"), apart("end_ms", "right_start_ms")) > gap, "ADJACENT": next_to, "LOCKED": F.col("locked"), "OVERLAPPING": F.col("overlapping"),
        "NEIGHBOUR_OVERLAPPING": F.col("left_overlapping") | F.col("right_overlapping"), "BOUNDARY": F.col("boundary_conflict"), "NOT_IN_TOP": ~F.array_contains("top", F.col("target")),
    }
    blockers = F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))
    rows = rows.withColumn("blockers", blockers).withColumn("verdict", F.when(~F.col("island"), "NONE").when(F.col("margin") >= strong, "STRONG").when(F.size("blockers") > 0, "REVIEW").otherwise("OPEN"))
    support = segments.groupBy("recording_id", "speaker_id").agg(F.count("*").alias("n"))
    of = lambda c, name: support.select("recording_id", F.col("speaker_id").alias(c), F.col("n").alias(name))
    islands = rows.where("verdict = 'OPEN'").join(of("speaker_id", "n_own"), ["recording_id", "speaker_id"]).join(of("target", "n_target"), ["recording_id", "target"])

    def give(isles):
        left = {}
        for place, own, target, n_own, n_target in isles:
            left.setdefault(own, n_own)
            left.setdefault(target, n_target)
            if left[own] > 1:
                left[own] -= 1
                left[target] += 1
                yield place, True
            else:
                yield place, False

    given = by_group(islands, ["recording_id"], ["place", "speaker_id", "target", "n_own", "n_target"], give, "place int, applied boolean")
    done = rows.join(given, ["recording_id", "place"], "left")
    last = (F.col("verdict") == "OPEN") & ~F.col("applied")
    return done.select(
        *[f"`{c}`" for c in segments.columns], F.when(F.col("applied"), F.col("target")).otherwise(F.col("speaker_id")).alias("fixed"), F.when(F.col("applied"), "APPLIED").when(last, "REVIEW").otherwise(F.col("verdict")).alias("verdict"),
        F.when(~F.col("verdict").isin("REVIEW", "OPEN"), F.array().cast("array<string>")).when(last, F.array(F.lit("LAST_SUPPORT"))).otherwise(F.col("blockers")).alias("blockers"),
    )


def by_group(rows: DataFrame, keys: list[str], fields: list[str], step: Callable, out: str) -> DataFrame:
    """Rows of each key, sorted by all fields, through a generator of tuples from tuples; keys and `out` (DDL) are the columns of the result."""
    names, kinds = [x.split()[0] for x in out.split(", ")], dict(rows.dtypes)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = list(step(part.sort_values(fields)[fields].itertuples(index=False, name=None)))
        done = pd.DataFrame(found, columns=names)
        for k, (name, value) in enumerate(zip(keys, key, strict=True)):
            done.insert(k, name, value)
        return done

    return rows.select(*keys, *fields).groupBy(*keys).applyInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], out]))


def smooth_boundaries(segments: DataFrame, gap: int, overlap: int, least: int) -> DataFrame:
    """Small gaps and overlaps between neighbours are closed at their middle if both keep a least length; left to right."""

    def close(rows):
        last = None
        for start, segment, end in rows:
            if last is not None:
                apart, middle = start - last[2], (start + last[2]) // 2
                if apart and -overlap <= apart <= gap and middle - last[1] >= least and end - middle >= least:
                    last, start = (last[0], last[1], middle), middle
                yield last
            last = (segment, start, end)
        yield last

    return by_group(segments, ["recording_id"], ["start_ms", "segment_id", "end_ms"], close, "segment_id string, start_ms long, end_ms long")


def dedup_text(segments: DataFrame, least: int) -> DataFrame:
    """Drops a segment that repeats the kept one before, and cuts from its text what the end of that one already says."""
    prev = F.lag("text").over(Window.partitionBy("recording_id").orderBy("turn"))
    fresh = segments.withColumn("prev", prev).where(F.col("prev").isNull() | (F.lower(F.trim("prev")) != F.lower(F.trim("text"))))
    n = suffix_prefix("prev", "text", least)
    return fresh.select("segment_id", "recording_id", F.when(F.col("prev").isNull(), F.col("text")).otherwise(F.substr(F.col("text"), n + 1)).alias("text"))


def merge_with_text(segments: DataFrame, gap: int) -> DataFrame:
    """Segments of one speaker that overlap or nearly touch become one, texts joined in order."""
    keys = ["recording_id", "speaker_id"]
    return islands(segments, keys, gap).groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), ordered_text().alias("text")).drop("island")
