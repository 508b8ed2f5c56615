"""Frame features of several systems' turns, the weights that turn them into speakers, their fit against a reference and the choice of a threshold.

A cell is a speaker in a frame. All cells of a recording exist, from frame 0 to the last frame that a system's turn touches, silent ones too: they decide the bias of
activity and the share of each speaker in a frame. Tables are spread by (recording, frame), so a long recording is no single task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.operators.decoding import boundary_scores

CELL = ["recording_id", "frame", "speaker_id"]
#: Share of a frame from which a system counts as active; from which a firm system anchors a speaker (by 1), and the last one (by 0.5); from which the reference is active.
ACTIVE, FIRM, LOOSE, TRUE_SHARE = 0.25, 0.01, 0.20, 0.05
#: Weights of agreement, exclusive support, an anchor, its lack and the mass that a full system alone has, and the scale of the whole, in a speaker's prior.
PRIOR = {"agreement": 0.14, "exclusive": 0.22, "anchor": 0.16, "unanchored": 0.12, "alone": 0.28, "scale": 0.18}
#: Weights of primary accuracy, activity F1 and overlap F1 in the choice of a threshold; the penalty of squared weights.
OBJECTIVE, PENALTY = (1.0, 1.0, 1.35), 0.002
THRESHOLDS = tuple(0.20 + 0.05 * k for k in range(12))
OVERLAP_WEIGHTS = (1.0, 1.35, 1.70)


def feature_names(systems: list[str]) -> list[str]:
    """Support by system, the lesser support of each pair, agreement, boundary, exclusive, anchor, support by system times its quality."""
    return [*systems, *[f"{a}_{b}" for a, b in combinations(systems, 2)], "agreement", "boundary", "exclusive", "anchor", *[f"{s}_quality" for s in systems]]


def default_weights(systems: list[str], support: tuple, pairs: tuple, rest: tuple) -> dict[str, float]:
    """Weights by feature name from those of systems, pairs and (agreement, boundary, exclusive, anchor); quality counts 0."""
    return dict(zip(feature_names(systems), [*support, *pairs, *rest, *[0.0] * len(systems)], strict=True))


def support(turns: DataFrame, hop_ms: int, keys: tuple = ("recording_id", "system", "speaker_id")) -> DataFrame:
    """keys, frame and `share`, the greatest part of the frame that one turn covers. Turns without length give nothing; what lies before 0 is cut off."""
    part = F.least(F.col("end_ms"), (F.col("frame") + 1) * hop_ms) - F.greatest(F.col("start_ms"), F.col("frame") * hop_ms)
    frames = turns.withColumn("start_ms", F.greatest("start_ms", F.lit(0))).where("end_ms > start_ms").withColumn("frame", F.explode(F.expr(f"sequence(start_ms div {hop_ms}, (end_ms - 1) div {hop_ms})")))
    return frames.groupBy(*keys, "frame").agg(F.max(F.least(F.lit(1.0), part / hop_ms)).alias("share"))


def feature_cells(turns: DataFrame, quality: DataFrame, weights: dict[str, float], hop_ms: int, snap_ms: float, exclusive: str, overlap_votes: int = 2) -> DataFrame:
    """(recording_id, frame, speaker_id, features) of turns (with `system`, one of weights) and quality (recording_id, system, quality; missing: 0).

    `exclusive` names the system whose lone support counts, save where `overlap_votes` systems hear two speakers or more. All systems but the last are firm.
    """
    systems, name = list(weights), F.col("system")
    own = support(turns, hop_ms)
    known = own.groupBy("recording_id", "speaker_id").agg(
        F.max("frame").alias("last"), F.greatest(F.max(F.when(name.isin(systems[:-1]) & (F.col("share") > FIRM), 1.0).otherwise(0.0)), F.max(F.when((name == systems[-1]) & (F.col("share") > LOOSE), 0.5).otherwise(0.0))).alias("anchor")
    )
    known = known.withColumn("last", F.max("last").over(Window.partitionBy("recording_id")))
    rated = quality.groupBy("recording_id").agg(*[F.max(F.when(name == s, F.col("quality"))).alias(f"{s}_quality") for s in systems])
    given = ["anchor", *[f"{s}_quality" for s in systems]]
    # each cell's empty row brings what is the recording's or the speaker's, so that no join by recording meets all its frames
    empty = known.join(rated, "recording_id", "left").select("recording_id", "speaker_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in given])
    cells = own.unionByName(empty, allowMissingColumns=True).repartition("recording_id", "frame").groupBy(*CELL).agg(*[F.max(F.when(name == s, F.col("share")).otherwise(0.0)).alias(s) for s in systems], *[F.max(c).alias(c) for c in given])
    spine = known.select(F.col("recording_id").alias("key"), "last").distinct().select("key", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    near = boundary_scores(spine, turns.withColumnRenamed("recording_id", "key"), hop_ms, snap_ms, weights).withColumnRenamed("key", "recording_id")
    frame = Window.partitionBy("recording_id", "frame")
    active = {s: (F.col(s) > ACTIVE).cast("int") for s in systems}
    cells = cells.withColumns({f"n_{s}": F.sum(active[s]).over(frame) for s in systems}).join(near, ["recording_id", "frame"])
    crowded = sum((F.col(f"n_{s}") >= 2).cast("int") for s in systems) >= overlap_votes
    made = {
        **{s: F.col(s) for s in systems}, **{f"{a}_{b}": F.least(a, b) for a, b in combinations(systems, 2)}, "agreement": sum(active.values()) / len(systems), "boundary": F.col("boundary") * F.greatest(*systems),
        "exclusive": F.when((F.col(f"n_{exclusive}") <= 1) & ~crowded, F.col(exclusive)).otherwise(0.0), "anchor": F.col("anchor"), **{f"{s}_quality": F.col(s) * F.col(f"{s}_quality") for s in systems},
    }
    return cells.select(*CELL, *[F.round(made[c] + 1e-12, 6).alias(c) for c in feature_names(systems)])  # halves go up


def linear(weights: dict[str, float], bias: float = 0.0) -> Column:
    return sum((F.col(c) * F.lit(float(w)) for c, w in weights.items()), F.lit(float(bias)))


def posteriors(cells: DataFrame, primary: dict[str, float], activity: dict[str, float], bias: float) -> DataFrame:
    """cells with `primary`, the softmax over a frame's speakers, and `active`, each speaker's own probability."""
    frame = Window.partitionBy("recording_id", "frame")
    e = F.exp(F.col("__s") - F.max("__s").over(frame))
    return cells.withColumn("__s", linear(primary)).withColumn("__e", e).select(*cells.columns, (F.col("__e") / F.sum("__e").over(frame)).alias("primary"), (1 / (1 + F.exp(-linear(activity, bias)))).alias("active"))


def speaker_prior(cells: DataFrame, weights: dict[str, float], cap: int | None = None) -> DataFrame:
    """(recording_id, speaker_id, score, bias): weighted mass of a speaker over a recording, and its place among the recording's speakers in standard deviations, scaled.

    Where the last system hears `cap` speakers or more, its most, what it alone has counts against a speaker. Equal scores, one speaker among them, have a bias of 0.
    """
    systems = list(weights)
    alone = F.greatest(F.lit(0.0), F.col(systems[-1]) - F.greatest(*systems[:-1], F.lit(0.0)))
    mass = cells.groupBy("recording_id", "speaker_id").agg(*[F.sum(c).alias(c) for c in (*systems, "agreement", "exclusive")], F.max("anchor").alias("anchor"), F.sum(alone).alias("alone"))
    w = Window.partitionBy("recording_id")
    full = F.lit(False) if cap is None else F.sum((F.col(systems[-1]) > 0).cast("int")).over(w) >= cap
    score = sum(F.col(s) * v for s, v in weights.items()) + PRIOR["agreement"] * F.col("agreement") + PRIOR["exclusive"] * F.col("exclusive") + PRIOR["anchor"] * F.col("anchor") - PRIOR["unanchored"] * (1 - F.col("anchor"))
    scored = mass.withColumn("score", F.round(score - F.when(full, PRIOR["alone"] * F.col("alone")).otherwise(0.0), 6))
    spread = F.stddev_pop("score").over(w)
    return scored.select("recording_id", "speaker_id", "score", F.round(F.when(spread < 1e-6, 0.0).otherwise(PRIOR["scale"] * (F.col("score") - F.avg("score").over(w)) / spread), 6).alias("bias"))


def labelled_frames(cells: DataFrame, names: list[str], reference: DataFrame, hop_ms: int) -> DataFrame:
    """(recording_id, frame, cells of speaker_id, x, share, valid) against reference turns whose speakers carry the systems' names (see the speaker maps).

    Cells of speakers that the recording's reference doesn't know are not valid: they count for nobody's activity. Recordings without a reference are left out.
    """
    own = support(reference, hop_ms, ("recording_id", "speaker_id"))
    size = cells.groupBy("recording_id").agg(F.max("frame").alias("last"))
    empty = own.select("recording_id", "speaker_id").distinct().join(size, "recording_id").select("recording_id", "speaker_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"), F.lit(0.0).alias("share"))
    truth = own.unionByName(empty).groupBy(*CELL).agg(F.max("share").alias("share"))
    cell = F.struct("speaker_id", F.array(*names).alias("x"), F.coalesce("share", F.lit(0.0)).alias("share"), F.col("share").isNotNull().alias("valid"))
    frames = cells.join(truth, CELL, "left").groupBy("recording_id", "frame").agg(F.sort_array(F.collect_list(cell)).alias("cells"))  # a frame's speakers
    return frames.join(own.select("recording_id").distinct(), "recording_id", "left_semi")


def sums_of(x: np.ndarray, sizes: np.ndarray, share: np.ndarray, valid: np.ndarray, points: list[np.ndarray], overlap_weights: tuple) -> list[np.ndarray]:
    """Weight, loss, gradient and curvature, in one row each, of the primary head at points[0] and of an activity head for each overlap weight at the others."""
    starts = np.cumsum(sizes) - sizes
    frame_of = np.repeat(np.arange(len(sizes)), sizes)
    score = x @ points[0]
    top = np.maximum.reduceat(score, starts)
    e = np.exp(score - top[frame_of])
    total = np.add.reduceat(e, starts)
    best = np.maximum.reduceat(share, starts)
    spoken = best > 0
    hits = np.flatnonzero(share == best[frame_of])
    target = hits[np.unique(frame_of[hits], return_index=True)[1]]  # the first of equal speakers
    p = (e / total[frame_of] * spoken[frame_of])[:, None] * x
    mean = np.add.reduceat(p, starts)
    loss = (np.log(total) + top - score[target])[spoken].sum()
    out = [np.concatenate([[spoken.sum(), loss], (mean - x[target])[spoken].sum(axis=0), (p.T @ x - mean.T @ mean).ravel()])]
    truth = ((share > TRUE_SHARE) & valid).astype(float)
    crowd = (np.add.reduceat(truth, starts) >= 2)[frame_of]
    wide = np.hstack([x, np.ones((len(x), 1))])
    for over, point in zip(overlap_weights, points[1:], strict=True):
        z = wide @ point
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        w = valid * (1 + (over - 1) * truth * crowd)
        curvature = ((w * q * (1 - q))[:, None] * wide).T @ wide
        out.append(np.concatenate([[w.sum(), (w * (np.logaddexp(0, z) - truth * z)).sum()], wide.T @ (w * (q - truth)), curvature.ravel()]))
    return out


def one_pass(frames: DataFrame, points: list[np.ndarray], overlap_weights: tuple) -> list[np.ndarray]:
    """sums_of over all frames: a row of sums from each task, added up by place; what comes back has a size fixed by the features."""
    d = len(points[0])

    def task(batches):
        found = None
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            if not len(sizes):
                continue
            flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "share", "valid")]
            rows = np.concatenate(sums_of(flat[0].reshape(-1, d), sizes, flat[1], flat[2].astype(bool), points, overlap_weights))
            found = rows if found is None else found + rows
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.tolist()], pa.list_(pa.float64()))], ["part"])

    flat = frames.select(F.size("cells").alias("n"), F.flatten("cells.x").alias("x"), F.col("cells.share").alias("share"), F.col("cells.valid").alias("valid"))
    rows = flat.mapInArrow(task, "part array<double>").select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    ends = np.cumsum([2 + len(p) + len(p) ** 2 for p in points])
    return np.split(np.array([r.s for r in rows]), ends[:-1])


def fit(frames: DataFrame, names: list[str], overlap_weights: tuple = OVERLAP_WEIGHTS, penalty: float = PENALTY, most_passes: int = 40, close: float = 1e-9) -> tuple[np.ndarray, list[np.ndarray]]:
    """(primary weights, for each overlap weight activity weights with the bias last) that have the least mean loss with the penalty on squares (the bias goes free).

    frames are labelled_frames, kept by the caller (each pass reads them). Newton steps, halved where the loss would grow; all heads go in one pass. Weights on a
    head's whole loss would change nothing at its minimum, so only the weight of overlapped speech against the rest is a choice. Without labelled frames all weights are 0.
    """
    d = len(names)
    points = [np.zeros(d), *[np.zeros(d + 1) for _ in overlap_weights]]
    held = [(np.inf, p, np.zeros_like(p)) for p in points]
    done = [False] * len(points)
    for _ in range(most_passes):
        parts = one_pass(frames, points, overlap_weights)
        if not len(parts[0]):
            break
        for k, (part, point) in enumerate(zip(parts, points, strict=True)):
            n, size = max(part[0], 1e-12), len(point)
            ridge = penalty * (np.arange(size) < d)
            loss = part[1] / n + (ridge * point**2).sum() / 2
            if done[k]:
                continue
            if loss > held[k][0] + 1e-13:
                held[k] = (held[k][0], held[k][1], held[k][2] / 2)
                done[k] = np.abs(held[k][2]).max() < close
            else:
                gradient = part[2 : 2 + size] / n + ridge * point
                step = np.linalg.solve(part[2 + size :].reshape(size, size) / n + np.diag(ridge + 1e-12), gradient)
                held[k] = (loss, point, step)
                done[k] = np.abs(step).max() < close
        if all(done):
            break
        points = [p if over else p - step for (_, p, step), over in zip(held, done, strict=True)]
    return held[0][1], [h[1] for h in held[1:]]


def threshold_sweep(frames: DataFrame, primary: np.ndarray, activity: np.ndarray, thresholds: tuple = THRESHOLDS, objective: tuple = OBJECTIVE) -> list[dict]:
    """Activity F1, overlap F1 (frames of two speakers or more; both means over recordings), primary accuracy and their weighted sum at each threshold; `best` marks the first greatest.

    One aggregation of counts by recording and number of thresholds reached; sums from above give each threshold's counts. activity has the bias last.
    """
    product = lambda x, w: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    reached = lambda p: sum((F.coalesce(p, F.lit(-1.0)) >= F.lit(t)).cast("int") for t in thresholds)
    scored = frames.select("recording_id", F.transform("cells", lambda c: F.struct(
        c.valid.alias("valid"), (c.valid & (c.share > TRUE_SHARE)).alias("truth"), c.share.alias("share"), F.round(product(c.x, primary), 9).alias("s"), F.round(1 / (1 + F.exp(-(product(c.x, activity[:-1]) + float(activity[-1])))), 9).alias("p"))).alias("cells"))
    valid = F.filter("cells", lambda c: c.valid)
    second = F.get(F.sort_array(F.transform(valid, lambda c: c.p), False), 1)
    row = lambda kind, k, truth: F.struct(F.lit(kind).alias("kind"), k.alias("k"), truth.alias("truth"))
    first_of = lambda c: F.array_position(c, F.array_max(c))
    rows = F.concat(
        F.transform(valid, lambda c: row("activity", reached(c.p), c.truth)), F.array(row("overlap", reached(second), F.size(F.filter(valid, lambda c: c.truth)) >= 2)),
        F.when(F.array_max("cells.share") > 0, F.array(row("primary", F.lit(0), first_of(F.col("cells.s")) == first_of(F.col("cells.share"))))).otherwise(F.array().cast("array<struct<kind:string,k:int,truth:boolean>>")),
    )
    counts = scored.select("recording_id", F.explode(rows).alias("r")).groupBy("recording_id", "r.kind", "r.k").agg(F.sum(F.col("r.truth").cast("long")).alias("yes"), F.sum((~F.col("r.truth")).cast("long")).alias("no"))
    total = F.sum("yes").over(Window.partitionBy("recording_id", "kind"))
    above = counts.where("kind <> 'primary'").withColumn("total", total).where("k > 0").select("recording_id", "kind", F.explode(F.sequence(F.lit(1), "k")).alias("k"), "yes", "no", "total")
    f1 = above.groupBy("recording_id", "kind", "k").agg((2 * F.sum("yes") / (F.sum("yes") + F.sum("no") + F.max("total"))).alias("f1"))
    sums = {(r.kind, r.k): r.s for r in f1.groupBy("kind", "k").agg(F.sum("f1").alias("s")).collect()}
    whole = counts.agg(F.count_distinct("recording_id").alias("n"), *[F.sum(F.when(F.col("kind") == "primary", F.col(c)).otherwise(0)).alias(c) for c in ("yes", "no")]).first()
    accuracy, n = (whole.yes or 0) / max(1, (whole.yes or 0) + (whole.no or 0)), max(1, whole.n)
    out = []
    for k, t in enumerate(thresholds, start=1):
        found = {"threshold": round(t, 9), "activity_f1": round(sums.get(("activity", k), 0.0) / n, 9), "overlap_f1": round(sums.get(("overlap", k), 0.0) / n, 9), "primary_accuracy": round(accuracy, 9)}
        out.append(found | {"objective": round(sum(w * found[c] for w, c in zip(objective, ("primary_accuracy", "activity_f1", "overlap_f1"), strict=True)), 9)})
    best = max(out, key=rank)
    return [r | {"best": r is best} for r in out]


def rank(r: dict) -> tuple:
    return r["objective"], r["overlap_f1"], r["activity_f1"], r["primary_accuracy"]


def calibrated(frames: DataFrame, names: list[str], overlap_weights: tuple = OVERLAP_WEIGHTS, thresholds: tuple = THRESHOLDS) -> dict:
    """The fit, overlap weight and threshold of greatest objective: `primary`, `activity` and `bias`, `overlap_weight` and the threshold's measures."""
    primary, heads = fit(frames, names, overlap_weights)
    tried = []
    for over, head in zip(overlap_weights, heads, strict=True):
        best = next(r for r in threshold_sweep(frames, primary, head, thresholds) if r["best"])
        tried.append(best | {"overlap_weight": over, "primary": dict(zip(names, primary, strict=True)), "activity": dict(zip(names, head[:-1], strict=True)), "bias": float(head[-1])})
    return max(tried, key=rank)
