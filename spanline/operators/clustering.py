"""Clustering of voice vectors and fusion of several systems on a frame grid.

Loops run on the driver, but each round is a job over all vectors or frames; what comes back is a few centroids or sums.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.functions.vectors import cosine, dot, unit
from spanline.lineage import cut
from spanline.operators.diarization import best_assignment
from spanline.operators.graphs import components, connectivity_profile, cosine_tree


def unit_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v): vectors of length one."""
    return df.select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("v"))


def literal(vectors: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in vectors])


def assigned(points: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """points with the nearest centroid by cosine (ties: the lowest number), or the one of its lock where it has one, and its similarity."""
    ways = F.transform(literal(centroids), lambda c, k: F.struct(F.round(dot(F.col("v"), c), 12).alias("s"), (-k).alias("k")))
    if "lock" not in points.columns:
        return points.withColumn("b", F.array_max(ways)).select("vec_id", "v", (-F.col("b.k")).alias("cluster"), F.col("b.s").alias("similarity"))
    best = F.when(F.col("lock").isNull(), F.array_max("ways")).otherwise(F.get("ways", F.col("lock")))
    return points.withColumn("ways", ways).withColumn("b", best).select("vec_id", "v", (-F.col("b.k")).alias("cluster"), F.col("b.s").alias("similarity"), "lock")


def mean_vectors(points: DataFrame) -> dict[int, list[float]]:
    """Mean vector of each cluster."""
    sums = points.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return {r.cluster: list(r.v) for r in sums.collect()}


def centroids_of(points: DataFrame) -> dict[int, list[float]]:
    """Normalised mean vector of each cluster."""
    return {c: (np.array(v) / max(np.linalg.norm(v), 1e-12)).round(12).tolist() for c, v in mean_vectors(points).items()}


def spherical_kmeans(points: DataFrame, k: int, rounds: int = 10) -> tuple[DataFrame, list[list[float]]]:
    """Farthest-first start from the smallest id, then assignment and mean until nothing moves; an empty cluster takes the free point farthest from its own.

    With a column `lock` (int, null for a free point) a point's cluster is fixed: locks 0, 1, ... start from the mean of their points, the other clusters farthest-first.
    """
    points = cut(points)
    free, centres = points, []
    if "lock" in points.columns:
        free = points.where(F.col("lock").isNull())
        fixed = centroids_of(points.where(F.col("lock").isNotNull()).withColumn("cluster", F.col("lock")))
        if set(fixed) != set(range(len(fixed))) or len(fixed) > k:
            raise ValueError(f"locks must be 0, 1, ... and fewer than {k} or as many: {sorted(fixed)}")
        centres = [fixed[c] for c in sorted(fixed)]
    if not centres:
        centres.append(points.orderBy("vec_id").first().v)
    while len(centres) < k:
        nearest = assigned(free, centres).orderBy("similarity", "vec_id").first()
        if nearest is None:
            raise ValueError(f"fewer points than {k} clusters")
        centres.append(nearest.v)
    for _ in range(rounds):
        own = assigned(points, centres)
        new = centroids_of(own)
        worst = (own.where(F.col("lock").isNull()) if "lock" in points.columns else own).orderBy("similarity", "vec_id").limit(k).collect() if len(new) < k else []
        after = [new.get(c) or worst.pop(0).v for c in range(k)]
        if np.allclose(after, centres, atol=1e-9):
            break
        centres = after
    return assigned(points, centres), centres


def cluster_quality(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Measures of a clustering of unit vectors: compactness, centroid silhouette, Calinski-Harabasz, Davies-Bouldin, least distance of centroids, and the share of vectors in clusters of fewer than a tenth of the mean size.

    Vectors are summed up by cluster; only the clusters' sizes, sums and mean distances come to the driver.
    """
    ways = F.transform(literal(centres), lambda c: dot(F.col("v"), c))
    other = F.array_max(F.filter(ways, lambda s, k: k != F.col("cluster")))
    a, b = 1 - F.col("similarity"), 1 - other
    k, middle = len(centres), np.array(centres)
    means = {c: np.array(v) for c, v in mean_vectors(points).items()}
    own = F.element_at(literal([means.get(c, middle[c]).tolist() for c in range(k)]), (F.col("cluster") + 1).cast("int"))
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z)
    rows = points.select("cluster", "similarity", ((b - a) / F.greatest(a, b, F.lit(1e-12))).alias("sil"), apart(F.col("v"), own).alias("d"))
    per = {r.cluster: r for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("similarity").alias("near"), F.sum("sil").alias("sil"), F.sum("d").alias("d"), F.sum(F.sqrt("d")).alias("root")).collect()}
    n = sum(r.n for r in per.values())
    m = sorted(per)
    whole = sum(per[c].n * means[c] for c in m) / max(n, 1)
    between, within = sum(per[c].n * float(((means[c] - whole) ** 2).sum()) for c in m), sum(per[c].d for c in m)
    spread = {c: per[c].root / per[c].n for c in m}
    gap = {(x, y): float(np.linalg.norm(means[x] - means[y])) for x in m for y in m if x != y}
    several = len(m) > 1
    out = {
        "k": k, "n_clusters": len(m), "compactness": sum(r.near for r in per.values()) / max(n, 1), "silhouette": sum(r.sil for r in per.values()) / max(n, 1),
        "calinski_harabasz": between / (len(m) - 1) / max(within / max(n - len(m), 1), 1e-12) if several else None,
        "davies_bouldin": sum(max((spread[x] + spread[y]) / max(gap[x, y], 1e-12) for y in m if y != x) for x in m) / len(m) if several else None,
        "separation": min(gap.values()) if several else None, "fragmentation": sum(r.n for r in per.values() if 10 * r.n * len(m) < n) / max(n, 1),
    }
    kinds = ", ".join(f"{name} {'int' if name == 'k' else 'long' if name == 'n_clusters' else 'double'}" for name in out)
    return points.sparkSession.createDataFrame([tuple(round(x, 6) if isinstance(x, float) else x for x in out.values())], kinds)


#: Weights of a run's stability: adjusted Rand, Jaccard, co-association, aligned accuracy.
STABILITY = {"adjusted_rand": 0.35, "jaccard": 0.25, "coassociation": 0.2, "aligned_accuracy": 0.2}


def agreement(cells: dict[tuple[int, int], int], mapped: dict[int, int] | None = None) -> dict[str, float]:
    """Measures of two labelings from their table of counts; `mapped` takes labels of the second to those of the first, by default with the most common points."""
    two = lambda n: n * (n - 1) // 2
    left, right = Counter(), Counter()
    for (a, b), n in cells.items():
        left[a] += n
        right[b] += n
    both, one, other, total = (sum(map(two, x)) for x in (cells.values(), left.values(), right.values(), [sum(cells.values())]))
    if mapped is None:
        rows, columns = sorted(left), sorted(right)
        mapped = {columns[j]: rows[i] for i, j in best_assignment([[cells.get((a, b), 0) for b in columns] for a in rows])}
    spread = (one + other) / 2 - one * other / max(total, 1)
    rand = (both - one * other / max(total, 1)) / spread if abs(spread) > 1e-12 else float(both == one == other)
    clear = lambda x: round(min(1.0, max(0.0, x)), 9)
    return {
        "adjusted_rand": clear(rand), "jaccard": clear(both / (one + other - both) if one + other > both else 1), "coassociation": clear(1 - (one + other - 2 * both) / total if total else 1),
        "aligned_accuracy": clear(sum(n for (a, b), n in cells.items() if mapped.get(b) == a) / max(sum(cells.values()), 1)),
    }


def stability(points: DataFrame, own: DataFrame, centres: list[list[float]], runs: int = 5, seed: str = "stability", keep: float = 0.8) -> list[dict]:
    """For each run: a seeded hash keeps a share of the points (locked ones in any case), these are clustered anew, all points go to the new centroids, and the labels are compared with `own`.

    Labels are matched by the centroids' cosines. Only tables of k by k counts come to the driver.
    """
    out, k = [], len(centres)
    locked = F.col("lock").isNotNull() if "lock" in points.columns else F.lit(False)
    for run in range(runs):
        chance = F.pmod(F.xxhash64(F.lit(f"{seed}:{run}"), F.col("vec_id")), F.lit(1_000_000)) / 1_000_000
        kept = points.where(locked | (chance < keep))
        represented = own.join(kept.select("vec_id"), "vec_id", "left_semi").select("cluster").distinct().count()
        _, new = spherical_kmeans(kept, k)
        both = own.select("vec_id", F.col("cluster").alias("a")).join(assigned(points, new).select("vec_id", F.col("cluster").alias("b"), "similarity"), "vec_id")
        rows = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0.0), "similarity")).alias("s")).collect()
        near = np.array(centres) @ np.array(new).T + 1  # above 0, so that all are matched
        mapped = {b: a for a, b in best_assignment(near.tolist())}
        found = agreement({(r.a, r.b): r.n for r in rows}, mapped)
        total = sum(r.n for r in rows)
        out.append({"run": run, **found, "coverage": round(represented / k, 9), "compactness": round(sum(r.s for r in rows) / max(total, 1), 6), "stability": round(sum(w * found[m] for m, w in STABILITY.items()), 9)})
    return out


#: Weights of the measures in the consensus of a count, and how near to the best value a measure votes for it.
MEASURES = {
    "compactness": (0.18, 0.015), "silhouette": (0.16, 0.05), "calinski_harabasz": (0.11, 0.05), "davies_bouldin": (0.09, 0.05), "eigengap": (0.16, 0.05), "stability": (0.18, 0.03), "separation": (0.12, 0.04),
}


def count_bounds(available: int, mode: str = "auto", least: int | None = None, most: int | None = None, locks: int = 0, most_auto: int | None = None) -> range:
    """The counts that a policy allows: `manual` (least = most, exactly that), `hybrid` (least to most, hard) or `auto`; locks are a lower bound, points and most_auto upper ones. Contradictions are errors."""
    if mode == "manual":
        low = high = least or 0
    else:
        low, high = max(1, locks), min(available, most_auto or available)
        if mode == "hybrid":
            low, high = max(low, least or 1), min(high, most or high)
    if not max(1, locks) <= low <= high <= available:
        raise ValueError(f"no count is allowed: {low} to {high} of {available} points with {locks} locked speakers")
    return range(low, high + 1)


def sizes_of(own: DataFrame) -> dict[str, float]:
    """Cluster sizes: singletons, clusters of at most two points and under a twentieth of the mean size, the least; and 1 - mean similarity."""
    sizes = own.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("similarity").alias("s")).collect()
    total, least = sum(r.n for r in sizes), min(r.n for r in sizes)
    return {"singletons": sum(r.n == 1 for r in sizes), "tiny": sum(r.n == 1 or (r.n <= 2 and 20 * r.n * len(sizes) <= total) for r in sizes), "least_size": least, "residual": round(1 - sum(r.s for r in sizes) / total, 6)}


def lone_outlier(fewer: dict, more: dict) -> bool:
    """Whether the step from one count to the next only parts a single point from clusters that hold together without: such a point makes no speaker."""
    return (
        more["k"] == fewer["k"] + 1 and more["singletons"] == more["tiny"] == more["least_size"] == 1 and fewer["singletons"] == fewer["tiny"] == 0 and fewer["least_size"] >= 2
        and fewer["compactness"] >= 0.75 and fewer["residual"] <= 0.25 and fewer["stability"] >= 0.9 and more["stability"] >= fewer["stability"] - 0.1
    )


def close_voices(fewer: dict, more: dict) -> bool:
    """Whether the step to the next count takes four fifths of the residual away with stable clusters of two points or more: two voices near each other."""
    return (
        more["k"] == fewer["k"] + 1 and fewer["singletons"] == fewer["tiny"] == more["singletons"] == more["tiny"] == 0 and more["least_size"] >= 2 and fewer["residual"] >= 1e-5
        and more["residual"] <= 0.2 * fewer["residual"] and more["compactness"] > fewer["compactness"] and more["silhouette"] >= fewer["silhouette"]
        and more["stability"] >= 0.9 and more["stability"] >= fewer["stability"] - 0.08
    )


def choose_count(points: DataFrame, counts: range, runs: int = 3) -> DataFrame:
    """(k, each measure, votes, consensus, score, chosen, reason): the number of clusters by the votes of seven measures, then their weighted consensus.

    A measure votes for the counts near its best value. Then the choice moves down while the last cluster is a lone outlier, and up where the next count parts close voices;
    with one allowed count there is nothing to choose. Only tables with a row a count or a cluster come to the driver.
    """
    points = cut(points)
    profile = connectivity_profile(cosine_tree(points)).where(F.col("n_groups").between(counts[0], counts[-1])).collect()
    gaps, rows = {r.n_groups: r.score for r in profile}, []
    for k in counts:
        own, centres = spherical_kmeans(points, k)
        own = cut(own)
        q = cluster_quality(own.drop("lock"), centres).first()
        row = {"k": k, "compactness": q.compactness, "silhouette": q.silhouette if k > 1 else 0.0, "separation": q.separation or 0.0, "eigengap": gaps.get(k, 0.0)}
        row |= {"calinski_harabasz": (q.calinski_harabasz or 0) / (1 + (q.calinski_harabasz or 0)), "davies_bouldin": 1 / (1 + q.davies_bouldin) if q.davies_bouldin is not None else 0.0}
        again = stability(points, own, centres, runs)
        rows.append(row | sizes_of(own) | {"stability": sum(x["stability"] for x in again) / len(again)})
    best = {m: max(r[m] for r in rows) for m in MEASURES}
    for r in rows:
        r["votes"] = sum(best[m] - r[m] <= near for m, (_, near) in MEASURES.items())
        r["consensus"] = sum(w * (1.0 if best[m] <= 1e-12 else min(1.0, max(0.0, r[m] / best[m]))) for m, (w, _) in MEASURES.items())
    at, reason = max(range(len(rows)), key=lambda i: (rows[i]["votes"], rows[i]["consensus"], -i)), "votes"
    while at + 1 < len(rows) and close_voices(rows[at], rows[at + 1]):
        at, reason = at + 1, "close voices"
    while at and lone_outlier(rows[at - 1], rows[at]):
        at, reason = at - 1, "lone outlier"
    fields = ["k", *MEASURES, "residual", "singletons", "least_size", "votes", "consensus"]
    kinds = {"k": "int", "singletons": "int", "least_size": "long", "votes": "int"}
    data = [tuple(round(r[f], 6) if isinstance(r[f], float) else r[f] for f in fields) + (i == at, reason if i == at else None) for i, r in enumerate(rows)]
    return points.sparkSession.createDataFrame(data, ", ".join(f"{f} {kinds.get(f, 'double')}" for f in fields) + ", chosen boolean, reason string")


#: Vectors of a query block, and of the points that a task compares with it at once.
BLOCK, CHUNK = 8_192, 512


def links_to(ids: np.ndarray, block: np.ndarray, batches, threshold: float):
    """Links that join the same points as all pairs of cosine at least the threshold between a block of unit vectors and the points of a task: one a point and one a block vector at most."""
    root = np.arange(len(ids))
    for batch in batches:
        own, vectors = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v").flatten().to_numpy().reshape(len(batch), -1)
        out = []
        for k in range(0, len(own), CHUNK):
            near = np.round(vectors[k : k + CHUNK] @ block.T, 12) >= threshold
            for i in np.flatnonzero(near.any(axis=1)):
                found = np.unique(root[near[i]])
                if len(found) > 1:
                    root[np.isin(root, found)] = found[0]
                out.append((own[k + i], ids[found[0]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
    rest = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[rest], pa.int64()), pa.array(ids[root[rest]], pa.int64())], names=["a", "b"])


def leader_groups(points: DataFrame, threshold: float, block_rows: int = BLOCK) -> DataFrame:
    """Groups of vectors linked by a cosine of at least the threshold (above 0), as components of the links.

    Equal vectors count once. The others are dealt into blocks of about `block_rows`; each block in turn is a broadcast that all
    vectors of this and later blocks are compared with, so every pair is looked at. A zero vector is a group of its own.
    """
    spark = points.sparkSession
    points = cut(points.select(F.col("vec_id").cast("long").alias("vec_id"), "v"))
    one = points.where(F.exists("v", lambda x: x != 0)).groupBy("v").agg(F.min("vec_id").alias("vec_id"))
    blocks = max(1, -(-one.count() // block_rows))
    one = cut(one.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")))
    links = points.join(one.select("v", F.col("vec_id").alias("b")), "v").where("vec_id <> b").select(F.col("vec_id").alias("a"), "b")
    for k in range(blocks):
        rows = one.where(F.col("block") == k).select("vec_id", "v").toArrow().combine_chunks()
        if not len(rows):
            continue
        ids = rows.column("vec_id").to_numpy()
        query = spark.sparkContext.broadcast((ids, np.concatenate([c.flatten().to_numpy() for c in rows.column("v").chunks]).reshape(len(ids), -1)))
        own = one.where(F.col("block") >= k).select("vec_id", "v").mapInArrow(lambda batches, query=query: links_to(*query.value, batches, threshold), "a long, b long")
        links = links.unionByName(cut(own.where("a <> b")))
        query.unpersist()
    found = components(links)
    return points.select("vec_id").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", F.coalesce("label", "vec_id").alias("label"))


def frame_grid(turns: DataFrame, hop_ms: int) -> DataFrame:
    """(recording_id, system, frame, speaker_id): the frames whose middle a turn covers."""
    first, last = F.ceil((F.col("start_ms") - hop_ms / 2) / hop_ms), F.ceil((F.col("end_ms") - hop_ms / 2) / hop_ms) - 1
    return turns.withColumn("f", first).withColumn("l", last).where("f <= l").select("recording_id", "system", "speaker_id", F.explode(F.sequence("f", "l")).alias("frame")).distinct()


def emissions(grid: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted share of the systems that have a speaker active in a frame."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("system")]
    return grid.groupBy("recording_id", "frame", "speaker_id").agg(F.round(F.sum(w) / sum(weights.values()), 9).alias("p"))


def viterbi(scores: np.ndarray, switch: float) -> list[int]:
    """The best path over rows of scores with a cost for each switch."""
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        stay, jump = best, best.max() - switch
        back.append(np.where(stay >= jump, np.arange(len(row)), best.argmax()))
        best = np.maximum(stay, jump) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def system_quality(grid: DataFrame, turns: DataFrame, n_frames: int, short_ms: int = 600, per_minute: float = 28.0, hop_ms: int = 1000) -> DataFrame:
    """(recording_id, system, agreement, coverage, quality) of each system in each recording, from 0.12 to 1.

    Weights: agreement with any other system over its frames (0.48), what it alone has (0.16), short turns (0.14), turns a minute (0.10) and distance from the middle
    number of speakers of all systems (0.12); a coverage unlike the others' mean takes up to 0.55 off. Without another system agreement counts one half.
    """
    ids = ["recording_id", "system"]
    shared = grid.groupBy("recording_id", "frame", "speaker_id").agg(F.count("*").alias("systems"))
    mass = grid.join(shared, ["recording_id", "frame", "speaker_id"]).groupBy(*ids).agg(F.avg((F.col("systems") > 1).cast("double")).alias("agreement"), (F.count_distinct("frame") / n_frames).alias("coverage"))
    length = F.col("end_ms") - F.col("start_ms")
    own = turns.where(length > 0).groupBy(*ids).agg(F.count("*").alias("turns"), F.count_distinct("speaker_id").alias("n"), F.avg((length <= short_ms).cast("double")).alias("short"))
    peers = mass.join(own, ids).groupBy("recording_id").agg(F.count("*").alias("m"), F.sum("coverage").alias("covered"), F.sort_array(F.collect_list("n")).alias("counts"))  # one row a system
    middle = F.get("counts", F.expr("cast((m - 1) div 2 AS int)"))
    x = mass.join(own, ids).join(peers, "recording_id").withColumns({"alone": F.col("m") < 2, "peer": (F.col("covered") - F.col("coverage")) / F.greatest(F.lit(1), F.col("m") - 1), "middle": middle})
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    agreement = F.when(F.col("alone"), 0.5).otherwise(F.col("agreement"))
    lonely = F.when(F.col("alone"), 0.0).otherwise(1 - F.col("agreement"))
    density = F.col("turns") / F.greatest(F.lit(0.001), F.lit(n_frames * hop_ms / 60_000)) / per_minute
    quality = 0.48 * clip(agreement) + 0.16 * (1 - clip(lonely)) + 0.14 * (1 - F.col("short")) + 0.10 * (1 - clip(density)) + 0.12 * (1 - clip(F.abs(F.col("n") - F.col("middle")) / F.greatest(F.lit(1), F.col("middle"))))
    unlike = F.when(~F.col("alone") & (F.col("peer") > 0), clip(F.abs(F.col("coverage") - F.col("peer")) / F.greatest(F.lit(0.1), F.col("peer") + 0.05))).otherwise(0.0)
    return x.select(*ids, F.round("agreement", 9).alias("agreement"), F.round("coverage", 9).alias("coverage"), F.round(F.greatest(F.lit(0.12), F.least(F.lit(1.0), quality * F.greatest(F.lit(0.45), 1 - 0.5 * unlike))), 6).alias("quality"))


def frame_runs(frames: DataFrame, keys: list[str], hop_ms: int, value: str | None = None) -> DataFrame:
    """Runs of frames in a row with equal keys, as spans, with the mean of a value."""
    w = Window.partitionBy(*keys).orderBy("frame")
    runs = frames.withColumn("run", F.col("frame") - F.row_number().over(w))
    out = [F.min("frame").alias("a"), F.max("frame").alias("b"), *([F.round(F.avg(value), 6).alias("mean")] if value else [])]
    return runs.groupBy(*keys, "run").agg(*out).select(*keys, (F.col("a") * hop_ms).cast("long").alias("start_ms"), ((F.col("b") + 1) * hop_ms).cast("long").alias("end_ms"), *(["mean"] if value else []))


def consensus_labels(grid: DataFrame, least: int = 2) -> DataFrame:
    """The speaker on which most systems agree in a frame, if at least `least` do and no other has as many."""
    votes = grid.groupBy("recording_id", "frame", "speaker_id").agg(F.count_distinct("system").alias("n"))
    best = votes.groupBy("recording_id", "frame").agg(F.max(F.struct("n", "speaker_id")).alias("b"), F.slice(F.sort_array(F.collect_list("n"), False), 1, 2).alias("top"))
    clear = (F.col("b.n") >= least) & ((F.size("top") < 2) | (F.col("top")[0] > F.col("top")[1]))
    return best.where(clear).select("recording_id", "frame", F.col("b.speaker_id").alias("speaker_id"), F.col("b.n").alias("n_systems"))


def merge_runs(pairs: DataFrame, least: float = 0.5, conflicts: DataFrame | None = None) -> DataFrame:
    """Greedy merging by rounds until none merges: in each, every group takes its best partner if they choose each other and score enough; all recordings go on at once.

    pairs: (key, a, b, score); the score of two groups is the mean over the pairs between them. conflicts: (key, a, b) that must stay apart, such as runs that overlap in time;
    a merged group has the conflicts of both its parts, so none ever holds two runs in conflict. Gives (key, member, label), the label being the least member.
    Pairs and conflicts are carried on as sums between groups, so a round costs what is left of them.
    """
    ends = [pairs.select("key", F.col(c).alias("member")) for c in "ab"] + ([conflicts.select("key", F.col(c).alias("member")) for c in "ab"] if conflicts is not None else [])
    nodes = ends[0]
    for x in ends[1:]:
        nodes = nodes.union(x)
    label = cut(nodes.distinct().withColumn("label", F.col("member")))
    between = lambda df, *sums: df.where("a <> b").groupBy("key", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(*sums)
    ways = cut(between(pairs, F.sum("score").alias("s"), F.count("*").alias("n")))
    apart = cut(between(conflicts, F.lit(True).alias("apart"))) if conflicts is not None else None
    while True:
        open_ways = ways.withColumn("score", F.round(F.col("s") / F.col("n"), 9)).where(F.col("score") >= least)
        if apart is not None:
            open_ways = open_ways.join(apart, ["key", "x", "y"], "left_anti")
        open_ways = open_ways.withColumn("tie", F.xxhash64("key", "x", "y"))  # ties by a hash of the pair, so that long rows of equal scores merge at many places at once
        both = open_ways.select("key", F.col("x").alias("g"), F.col("y").alias("o"), "score", "tie").unionByName(open_ways.select("key", F.col("y").alias("g"), F.col("x").alias("o"), "score", "tie"))
        best = both.groupBy("key", "g").agg(F.max(F.struct("score", "tie", "o")).alias("b")).select("key", "g", "b.o")
        mutual = cut(best.alias("p").join(best.alias("q"), F.expr("p.key = q.key AND p.g = q.o AND p.o = q.g AND p.g > p.o")).select("p.key", F.col("p.g").alias("label"), F.col("p.o").alias("to")))
        if not mutual.limit(1).count():
            return label
        label = cut(label.join(mutual, ["key", "label"], "left").select("key", "member", F.coalesce("to", "label").alias("label")))

        def moved(df: DataFrame, mutual: DataFrame = mutual) -> DataFrame:
            for side in "xy":
                df = df.join(mutual.select("key", F.col("label").alias(side), F.col("to").alias(f"to_{side}")), ["key", side], "left")
            return df.withColumns({"a": F.coalesce("to_x", "x"), "b": F.coalesce("to_y", "y")})

        ways = cut(between(moved(ways), F.sum("s").alias("s"), F.sum("n").alias("n")))
        apart = cut(between(moved(apart), F.lit(True).alias("apart"))) if apart is not None else None
