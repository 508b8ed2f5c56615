"""Verification and classification metrics over long tables of scores, labels and metrics.

Curves over thresholds use counts by distinct score and prefix sums in two levels: totals of score cells (a table whose
size is fixed by the cell width) and running sums inside each cell, so no task needs all scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.lineage import cut


def value_counts(df: DataFrame, field: str, unknown: str = "unknown") -> DataFrame:
    """Rows by value; a row with a list counts once for each value."""
    values = F.explode_outer(field) if dict(df.dtypes)[field].startswith("array") else F.col(field)
    return df.select(values.alias("value")).groupBy(F.coalesce(F.col("value").cast("string"), F.lit(unknown)).alias("value")).agg(F.count("*").alias("n"))


def bucket_summary(df: DataFrame, field: str, metric: str, eligible: str) -> DataFrame:
    """For each value of a list field: cases, mean of the metric where it is known, share of eligible cases."""
    one = df.select(F.explode_outer(field).alias("bucket"), metric, eligible)
    return one.groupBy(F.coalesce("bucket", F.lit("unknown")).alias("bucket")).agg(F.count("*").alias("n_cases"), F.count(metric).alias("n_scored"), F.round(F.avg(metric), 9).alias("mean"), F.round(F.avg(F.col(eligible).cast("int")), 9).alias("eligible_rate"))


def ratio(top: Column, bottom: Column) -> Column:
    return F.round(F.when(bottom > 0, top / bottom), 9)


def binary_metrics(df: DataFrame, truth: Column, predicted: Column, keys: list[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall and F1, by group."""
    counts = df.withColumn("__t", truth).withColumn("__p", predicted).groupBy(*keys).agg(
        F.count_if(F.expr("__t AND __p")).alias("tp"), F.count_if(F.expr("NOT __t AND __p")).alias("fp"), F.count_if(F.expr("__t AND NOT __p")).alias("fn"), F.count_if(F.expr("NOT __t AND NOT __p")).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], cells: int = 1024, weight: str | None = None) -> DataFrame:
    """keys (one at least) and a column for each of `points`: the exact percentile with linear interpolation at (n - 1) * p, null values aside; a row stands for `weight` rows where that column is named.

    Counts by distinct value come first. Each key's range is cut to `cells` equal cells; running counts over cells (a row a cell) show which cells hold the
    ranks that are sought, and running counts inside these alone find the values. So no task or buffer holds a key's values.
    """
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg((F.sum(weight) if weight else F.count("*")).alias("__n")))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    span = counts.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__all"))
    placed = counts.alias("l").join(span.alias("r"), same).select("l.*", "r.__lo", "r.__hi", "r.__all")
    width = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-300))
    placed = placed.withColumn("__cell", F.least(F.lit(cells - 1), F.floor((F.col("__v") - F.col("__lo")) / width * cells)).cast("int"))
    below = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "__cell", "__all").agg(F.sum("__n").alias("__in")).withColumn("__before", F.coalesce(F.sum("__in").over(below), F.lit(0)))
    ranks = F.array(*[f((F.col("__all") - 1) * F.lit(p)) for p in points.values() for f in (F.floor, F.ceil)])
    sums = sums.where(F.exists(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__in"))))
    near = placed.alias("l").join(sums.alias("r"), [*same, F.col("l.__cell") == F.col("r.__cell")]).select("l.*", "r.__before")
    inside = Window.partitionBy(*keys, "__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("__end", F.col("__before") + F.sum("__n").over(inside))
    at = lambda rank: F.max(F.when((rank >= F.col("__end") - F.col("__n")) & (rank < F.col("__end")), F.col("__v")))
    out = near.groupBy(*keys, "__all").agg(*[at(f((F.col("__all") - 1) * F.lit(p))).alias(f"__{side}{k}") for k, p in enumerate(points.values()) for side, f in (("l", F.floor), ("h", F.ceil))])
    part = lambda p: (F.col("__all") - 1) * F.lit(p) - F.floor((F.col("__all") - 1) * F.lit(p))
    return out.select(*keys, *[(F.col(f"__l{k}") + part(p) * (F.col(f"__h{k}") - F.col(f"__l{k}"))).alias(name) for k, (name, p) in enumerate(points.items())])


def rate_cube(df: DataFrame, keys: list[str], flag: str, value: str) -> DataFrame:
    """Rate of a flag, and mean and percentiles of a value, over the cube of the keys; `all` stands for any, and for a null key."""
    fine = df.groupBy(*keys, F.col(value).alias("__value")).agg(F.count("*").alias("__n"), F.count(flag).alias("__known"), F.sum(F.col(flag).cast("int")).alias("__f"))
    sets = F.array(*[F.struct(*[(F.col(k).cast("string") if kept >> i & 1 else F.lit(None).cast("string")).alias(k) for i, k in enumerate(keys)], F.lit(kept).alias("__set")) for kept in range(1 << len(keys))])
    rows, ids = cut(fine.select(F.explode(sets).alias("k"), "__value", "__n", "__known", "__f").select("k.*", "__value", "__n", "__known", "__f")), [*keys, "__set"]
    known = F.when(F.col("__value").isNotNull(), F.col("__n"))
    base = rows.groupBy(*ids).agg(F.sum("__n").alias("n"), F.round(F.sum("__f") / F.sum("__known"), 9).alias("rate"), F.round(F.sum(F.col("__value") * known) / F.sum(known), 6).alias("mean"))
    found = percentiles(rows, ids, "__value", {"p50": 0.5, "p95": 0.95}, weight="__n")
    both = base.alias("l").join(found.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ids], "left")
    return both.select(*[F.coalesce(f"l.{k}", F.lit("all")).alias(k) for k in keys], "n", "rate", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def failure_modes(df: DataFrame, codes: str) -> DataFrame:
    """Each code's count and share of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("code", "n", F.round(F.col("n") / F.col("total"), 9).alias("rate"))


def fixed_threshold(trials: DataFrame, threshold: float, keys: list[str] = ()) -> DataFrame:
    """False acceptance, false rejection and balanced accuracy where `score >= threshold` accepts."""
    accepted = F.col("score") >= threshold
    wrong = lambda same, bad: F.avg(F.when(F.col("same") == same, bad.cast("int")))
    out = trials.groupBy(*keys).agg(F.count_if("same").alias("n_genuine"), F.count_if(~F.col("same")).alias("n_impostor"), F.round(wrong(False, accepted), 9).alias("far"), F.round(wrong(True, ~accepted), 9).alias("frr"))
    return out.withColumn("balanced_accuracy", F.round(1 - (F.col("far") + F.col("frr")) / 2, 9))


def score_curve(trials: DataFrame, cell: float = 0.001) -> DataFrame:
    """By distinct score: pos and neg at it, and pos_below and neg_below it."""
    at = trials.groupBy("score").agg(F.count_if("same").alias("pos"), F.count_if(~F.col("same")).alias("neg")).withColumn("cell", F.floor(F.col("score") / cell))
    totals = at.groupBy("cell").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell: its number is bounded by the width
    starts = totals.select("cell", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("cell").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    return at.join(F.broadcast(starts), "cell").select("cell", "score", "pos", "neg", (F.col("p0") + run("pos")).alias("pos_below"), (F.col("n0") + run("neg")).alias("neg_below"))


def roc_auc(trials: DataFrame) -> DataFrame:
    """Share of (genuine, impostor) pairs in the right order, ties one half."""
    c = score_curve(trials)
    return c.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("w")).select("n_pos", "n_neg", F.round(F.col("w") / (F.col("n_pos") * F.col("n_neg")), 9).alias("auc"))


def operating_points(trials: DataFrame) -> DataFrame:
    """FAR and FRR at thresholds just below each distinct score, and above the greatest one."""
    c = score_curve(trials)
    totals = trials.agg(F.count_if("same").alias("p"), F.count_if(~F.col("same")).alias("n"), F.max("score").alias("top"))
    below = c.select(F.col("score").alias("threshold"), "pos_below", "neg_below").crossJoin(F.broadcast(totals))
    above = totals.select((F.col("top") + 1e-12).alias("threshold"), F.col("p").alias("pos_below"), F.col("n").alias("neg_below"), "p", "n", "top")
    both = below.unionByName(above)
    return both.select("threshold", (1 - F.col("neg_below") / F.col("n")).alias("far"), (F.col("pos_below") / F.col("p")).alias("frr"))


def eer_and_min_dcf(trials: DataFrame) -> DataFrame:
    """The point where FAR and FRR are nearest (then least sum, then least threshold), and the least of 0.99 FAR + 0.01 FRR."""
    p = operating_points(trials).select("*", F.round(F.abs(F.col("far") - F.col("frr")), 12).alias("gap"), F.round(F.col("far") + F.col("frr"), 12).alias("sum"), F.round(0.99 * F.col("far") + 0.01 * F.col("frr"), 12).alias("dcf"))
    best = p.agg(F.min(F.struct("gap", "sum", "threshold")).alias("e"), F.min("dcf").alias("min_dcf"))
    return best.select(F.round(F.col("e.sum") / 2, 9).alias("eer"), F.round("min_dcf", 9).alias("min_dcf"))


def calibration(df: DataFrame, p: Column, truth: Column, bins: int = 10) -> DataFrame:
    """Each bin's count, mean probability and share of positives; empty bins are listed, the last bin is closed."""
    own = df.select(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin"), p.alias("p"), truth.cast("int").alias("y"))
    got = own.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("mean_p"), F.round(F.avg("y"), 9).alias("share"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(got, "bin", "left").fillna(0, ["n"])


def calibration_errors(df: DataFrame, p: Column, truth: Column, bins: int = 10) -> DataFrame:
    """Brier score, log loss, expected and greatest calibration error."""
    q, y = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15)), truth.cast("int")
    base = df.select(p.alias("p"), y.alias("y"), (-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("l"), F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin"))
    per = base.groupBy("bin").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("b"), F.sum("l").alias("l"))
    gap = F.abs(F.col("sp") - F.col("sy"))
    return per.agg(F.round(F.sum("b") / F.sum("n"), 6).alias("brier"), F.round(F.sum("l") / F.sum("n"), 6).alias("log_loss"), F.round(F.sum(gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap / F.col("n")), 6).alias("mce"))


def platt(trials: DataFrame, steps: int = 25, penalty: float = 1e-6) -> tuple[float, float, float, float]:
    """(mean, scale, slope, intercept): logistic fit on standardised scores by Newton steps; each step is one aggregation of six sums."""
    m, s = trials.agg(F.avg("score"), F.stddev_pop("score")).first()
    s = s or 1.0
    a, b = 1.0, 0.0
    x, y = (F.col("score") - m) / s, F.col("same").cast("int")

    def sums(a: float, b: float):
        z = a * x + b
        q = 1 / (1 + F.exp(-z))
        w = q * (1 - q)
        loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
        return trials.agg(F.avg((q - y) * x), F.avg(q - y), F.avg(w * x * x), F.avg(w * x), F.avg(w), F.avg(loss)).first()

    now = sums(a, b)
    for _ in range(steps):
        ga, gb, haa, hab, hbb, loss = now
        ga, haa, hbb = ga + penalty * a, haa + penalty, hbb + 1e-12
        det = haa * hbb - hab * hab
        if not det or math.hypot(ga, gb) < 1e-9:
            break
        da, db, size = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0
        while True:
            new = sums(a - size * da, b - size * db)
            if new[5] <= loss or size < 1e-4:
                break
            size /= 2
        a, b, now = a - size * da, b - size * db, new
    return m, s, a, b


def gates(metrics: DataFrame) -> DataFrame:
    """Challenger against baseline by metric (columns metric, direction, baseline, challenger): passed, and whether all did."""
    ok = F.when(F.col("direction") == "max", F.col("challenger") >= F.col("baseline")).otherwise(F.col("challenger") <= F.col("baseline"))
    return metrics.select("metric", "direction", "baseline", "challenger", F.coalesce(ok, F.lit(False)).alias("passed"))


def percentile_rank(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Share of a group's rows that are not greater."""
    return df.withColumn("rank", F.round(F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)), 9))


def seeded_order(seed: str, *columns: str) -> Column:
    """A stable pseudo-random key: SHA-256 of the seed and the columns."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]).cast("binary"), 256)


def balanced_pairs(pairs: DataFrame, seed: str, per_class: int, apart: str | None = None, least: int = 0) -> DataFrame:
    """As many same as different pairs, the first by seeded order, at most `per_class` each: two top-k, so no task sees a whole class. Same pairs count only if their clips are `least` or more apart in the column `apart`."""
    pairs = pairs.where(~F.col("same") | (F.col(apart) >= least)) if apart else pairs
    counts = {r.same: r.n for r in pairs.groupBy("same").agg(F.count("*").alias("n")).collect()}
    n = min(per_class, counts.get(True, 0), counts.get(False, 0))
    one = lambda same: pairs.where(F.col("same") == same).orderBy(seeded_order(seed, "l", "r")).limit(n)
    return one(True).unionByName(one(False))
