"""Selections in which a pick depends on those before it, in a number of jobs that picks and rows do not decide."""

from __future__ import annotations

import hashlib
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.lineage import cut

from .sampling import case_features
from .scoring import seeded_order

#: Feature sets that come to the driver at once.
PAGE = 20_000


def diverse_cases(cases: DataFrame, most: int, page: int = PAGE) -> DataFrame:
    """(place, case_id): greedy pick of at most `most` cases; each takes the case whose features not yet covered weigh most (1 / how often a feature occurs), ties to the least id.

    Cases of one feature set are alike, so only the least id of each set competes. Gains only fall, so sets come to the driver in pages of falling
    first gain, a next one when the best gain left is below what the last page ended with. Once nothing is uncovered the rest goes by id.
    """
    sets = cases.select("case_id", F.array_sort(F.array_distinct(case_features(cases))).alias("features"))
    weight = sets.select(F.explode("features").alias("feature")).groupBy("feature").agg((1 / F.count("*")).alias("w"))
    first = sets.groupBy("features").agg(F.min("case_id").alias("case_id"))
    weighed = first.select("case_id", F.explode("features").alias("feature")).join(weight, "feature")
    ranked = cut(weighed.groupBy("case_id").agg(F.round(F.sum("w"), 12).alias("gain"), F.map_from_entries(F.collect_list(F.struct("feature", "w"))).alias("weights")))
    heap, covered, picked, last, features = [], set(), [], None, {}
    gain_of = lambda c: round(sum(w for f, w in features[c].items() if f not in covered), 12)
    while len(picked) < most:
        if last is not None and (not heap or -heap[0][0] < last[0]) or last is None:
            rest = ranked if last is None else ranked.where((F.col("gain") < last[0]) | ((F.col("gain") == last[0]) & (F.col("case_id") > last[1])))
            rows = rest.orderBy(F.desc("gain"), "case_id").limit(page).collect()
            for r in rows:
                features[r.case_id] = r.weights
                heapq.heappush(heap, (-r.gain, r.case_id))
            last = (rows[-1].gain, rows[-1].case_id) if len(rows) == page else (float("-inf"), None)
        if not heap:
            break
        gain, case = heapq.heappop(heap)
        now = gain_of(case)
        if now != -gain:
            heapq.heappush(heap, (-now, case))
        elif now <= 0:
            break
        else:
            picked.append(case)
            covered |= set(features[case])
    spark, kind = cases.sparkSession, dict(cases.dtypes)["case_id"]
    out = spark.createDataFrame(list(enumerate(picked)), f"place int, case_id {kind}")
    if len(picked) == most:
        return out
    others = cases.select("case_id").join(out.select("case_id"), "case_id", "left_anti").orderBy("case_id").limit(most - len(picked))
    return out.unionByName(others.select((F.row_number().over(Window.orderBy("case_id")) - 1 + len(picked)).cast("int").alias("place"), "case_id"))  # at most `most` rows


#: Buckets of disputed cases: whether only disagreements, the measure and its order, and the size of a pool in picks.
BUCKETS = {"high-conflict": (True, "conflict", False, 2), "disagreement": (True, "conflict", False, 3), "near-threshold": (False, "nearness", True, 3)}


def dispute_pools(rows: DataFrame, count: int, seed: str) -> DataFrame:
    """rows (case_id, same, disagreement, conflict, nearness, genre, speakers) that a pick of `count` cases can reach, with bucket and rank: for each bucket and truth the first by its measure, then seeded order. Their number follows from `count` alone."""
    if count < 6 or count % 6:
        raise ValueError("the number of cases must be a multiple of 6")
    target, out = count // 6, None
    for k, (name, (disputed, measure, ascending, size)) in enumerate(BUCKETS.items()):
        for same in (True, False):
            own = rows.where(F.col("same") == same)
            own = own.where("disagreement") if disputed else own
            key = F.col(measure) if ascending else -F.col(measure)
            top = own.withColumns({"key": key, "tie": seeded_order(seed, "case_id")}).orderBy("key", "tie").limit(target * (size + k))  # earlier buckets take `target` of this truth each
            top = top.withColumns({"bucket": F.lit(name), "rank": F.row_number().over(Window.orderBy("key", "tie"))})  # as many rows as the limit
            out = top if out is None else out.unionByName(top)
    return out


def balanced_disputes(rows: DataFrame, count: int, seed: str) -> DataFrame:
    """(place, bucket, case_id, same): `count` cases, a third from each bucket, half of each third same-speaker pairs.

    Within a bucket's pool each pick takes the genre picked least so far, then the speakers picked least, then the measure, then seeded order. A bucket that cannot fill its quota is an error.
    """
    pools, target = dispute_pools(rows, count, seed), count // 6

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        taken, genres, speakers, out = set(), {}, {}, []
        for bucket, (*_, size) in BUCKETS.items():
            done = set(taken)
            for same in (True, False):
                pool = part[(part["bucket"] == bucket) & (part["same"] == same) & ~part["case_id"].isin(done)].sort_values("rank").head(target * size)
                items = list(zip(pool["case_id"], pool["genre"], pool["speakers"], pool["key"], strict=True))
                for offset in range(target):
                    left = [x for x in items if x[0] not in taken]
                    if not left:
                        raise ValueError(f"bucket {bucket} has too few cases")
                    tie = lambda c: hashlib.sha256(f"{seed}:{bucket}:{same}:{offset}:{c}".encode()).hexdigest()  # noqa: B023, E731
                    case, genre, pair, _ = min(left, key=lambda x: (genres.get(x[1], 0), sum(speakers.get(s, 0) for s in x[2]), x[3], tie(x[0])))
                    taken.add(case)
                    genres[genre] = genres.get(genre, 0) + 1
                    for s in pair:
                        speakers[s] = speakers.get(s, 0) + 1
                    out.append((len(out), bucket, case, same))
        return pd.DataFrame(out, columns=["place", "bucket", "case_id", "same"])

    kind = dict(rows.dtypes)["case_id"]
    return pools.groupBy(F.lit(0).alias("all")).applyInPandas(pick, f"place int, bucket string, case_id {kind}, same boolean")


def stratified_windows(frames: DataFrame, spans: DataFrame, window_ms: int, seed: str, n_random: int = 2, n_change: int = 3) -> DataFrame:
    """(recording_id, reason, start_ms, end_ms, active_ratio, mean_change, max_change): windows over all of a recording, chosen without any result of a model.

    frames: (recording_id, start_ms, end_ms, active, change); spans: (recording_id, duration_ms). A window near the first, the middle and the last active frame (one where they
    fall together), then around seeded active frames, then around those of most change, the latter two at least half a window from all others. Each of these picks is one
    aggregation over all recordings; recordings shorter than a window or without active frames have none.
    """
    latest = F.col("duration_ms") - window_ms
    clip = lambda start: F.greatest(F.lit(0), F.least(latest, start)).cast("long")
    middle = F.expr("(start_ms + end_ms) div 2")
    around = clip(middle - window_ms // 2)
    active = cut(frames.where("active").join(spans.where(F.col("duration_ms") >= window_ms), "recording_id").select("recording_id", "duration_ms", "start_ms", "end_ms", "change", middle.alias("middle"), around.alias("at"), seeded_order(seed, "recording_id", "start_ms", "end_ms").alias("chance")))
    nearest = F.min(F.struct(F.abs(F.col("middle") - F.expr("duration_ms div 2")), F.col("start_ms"), F.col("at").alias("at")))
    strata = active.groupBy("recording_id", "duration_ms").agg(F.min("start_ms").alias("first"), F.max("end_ms").alias("last"), nearest.alias("m"))
    pick = lambda reason, at: F.struct(F.lit(reason).alias("reason"), at.alias("at"))
    chosen = strata.select("recording_id", F.array(pick("start", clip(F.col("first") - window_ms // 10)), pick("middle", F.col("m.at")), pick("end", clip(F.col("last") - window_ms * 9 // 10))).alias("chosen"))
    chosen = cut(chosen.select("recording_id", F.filter("chosen", lambda x, i: ~F.exists(F.slice("chosen", 1, i), lambda y: y["at"] == x["at"])).alias("chosen")))
    orders = [("random", k + 1, [F.col("chance"), F.col("start_ms")]) for k in range(n_random)] + [("change", k + 1, [-F.col("change"), F.col("start_ms")]) for k in range(n_change)]
    for kind, k, order in orders:
        free = active.join(chosen, "recording_id").where(~F.exists("chosen", lambda x: F.abs(x["at"] - F.col("at")) < window_ms // 2))
        best = free.groupBy("recording_id").agg(F.min(F.struct(*order, F.col("at").alias("at"))).alias("b")).select("recording_id", pick(f"{kind}-{k}", F.col("b.at")).alias("new"))
        chosen = cut(chosen.join(best, "recording_id", "left").select("recording_id", F.when(F.col("new").isNull(), F.col("chosen")).otherwise(F.array_append("chosen", F.col("new"))).alias("chosen")))
    windows = chosen.select("recording_id", F.explode("chosen").alias("w")).select("recording_id", "w.reason", F.col("w.at").alias("start_ms"))
    inside = frames.select("recording_id", middle.alias("middle"), "active", "change").join(windows, "recording_id").where(f"start_ms <= middle AND middle < start_ms + {window_ms}")  # a recording has at most 3 + n_random + n_change windows
    sums = inside.groupBy("recording_id", "reason").agg(F.avg(F.col("active").cast("int")).alias("a"), F.avg("change").alias("c"), F.max("change").alias("m"))
    known = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 9).alias(name)
    return windows.join(sums, ["recording_id", "reason"], "left").select("recording_id", "reason", "start_ms", (F.col("start_ms") + window_ms).alias("end_ms"), known("a", "active_ratio"), known("c", "mean_change"), known("m", "max_change"))
