"""Fits of both heads and threshold sweeps against plain forms, and features of small recordings."""

import math
import random

import numpy as np
import pytest

from spanline.operators import fusion as P

NAMES = ["f", "g"]


def small_frames(seed=5, n=40):
    """(recording, frame, cells of (speaker, x, share, valid)): noisy features of a truth with overlaps, silence and speakers without a reference."""
    rng, out = random.Random(seed), []
    for k in range(n):
        cells = []
        for speaker in "abc"[: rng.randint(1, 3)]:
            share = rng.choice([0.0, 0.0, 0.03, 0.5, 1.0])
            cells.append((speaker, [round(share + rng.gauss(0, 0.6), 3), round(rng.random(), 3)], share if speaker != "c" else 0.0, speaker != "c"))
        out.append((f"r{k % 3}", k, cells))
    return out


def frames_df(spark, rows, parts=3):
    return spark.createDataFrame(rows, "recording_id string, frame int, cells array<struct<speaker_id:string,x:array<double>,share:double,valid:boolean>>").repartition(parts)


def primary_loss(w, rows):
    total = n = 0
    for _, _, cells in rows:
        shares = [c[2] for c in cells]
        if max(shares) > 0:
            s = [float(np.dot(w, c[1])) for c in cells]
            total, n = total + math.log(sum(map(math.exp, s))) - s[shares.index(max(shares))], n + 1
    return total / n + P.PENALTY * float(np.dot(w, w)) / 2


def activity_loss(w, rows, over):
    total = n = 0
    for _, _, cells in rows:
        crowd = sum(c[3] and c[2] > 0.05 for c in cells) >= 2
        for _, x, share, valid in cells:
            if valid:
                z, y = float(np.dot(w[:-1], x)) + w[-1], share > 0.05
                weight = over if y and crowd else 1.0
                total, n = total + weight * (math.log1p(math.exp(z)) - (z if y else 0)), n + weight
    return total / n + P.PENALTY * float(np.dot(w[:-1], w[:-1])) / 2


def test_fit_finds_the_least_loss_however_rows_are_spread(spark):
    rows, found = small_frames(5, 120), []
    assert sum(sum(c[3] and c[2] > 0.05 for c in cells) >= 2 for _, _, cells in rows) > 5
    for parts in (1, 4):
        found.append(P.fit(frames_df(spark, rows, parts), NAMES, (1.0, 1.7)))
    (primary, heads), (again, others) = found
    assert np.allclose(primary, again, atol=1e-9) and all(np.allclose(a, b, atol=1e-9) for a, b in zip(heads, others, strict=True))
    for loss, w in [(lambda v: primary_loss(v, rows), primary), (lambda v: activity_loss(v, rows, 1.0), heads[0]), (lambda v: activity_loss(v, rows, 1.7), heads[1])]:
        for k in range(len(w)):
            e = np.zeros(len(w))
            e[k] = 1e-4
            assert abs(loss(w + e) - loss(w - e)) / 2e-4 < 1e-6  # a convex loss without slope
    assert not np.allclose(heads[0], heads[1], atol=1e-3)


def f1(pairs):
    tp, wrong = sum(p and t for p, t in pairs), sum(p != t for p, t in pairs)
    return 2 * tp / (2 * tp + wrong) if tp else 0.0


def test_sweep_equals_counting_at_each_threshold(spark):
    rows, primary, activity = small_frames(9, 60), [1.3, -0.2], [1.1, 0.4, -0.6]
    got = P.threshold_sweep(frames_df(spark, rows), primary, activity, (0.2, 0.45, 0.7, 0.999))
    p_of = lambda x: 1 / (1 + math.exp(-(np.dot(activity[:-1], x) + activity[-1])))
    said = [[np.dot(primary, c[1]) for c in cells] for _, _, cells in rows]
    right = [s.index(max(s)) == [c[2] for c in cells].index(max(c[2] for c in cells)) for s, (_, _, cells) in zip(said, rows, strict=True) if max(c[2] for c in cells) > 0]
    for row in got:
        own, crowd = {}, {}
        for r, _, cells in rows:
            pairs = [(p_of(c[1]) >= row["threshold"], c[2] > 0.05) for c in cells if c[3]]
            own.setdefault(r, []).extend(pairs)
            crowd.setdefault(r, []).append((sum(p for p, _ in pairs) >= 2, sum(t for _, t in pairs) >= 2))
        want = (np.mean([f1(v) for v in own.values()]), np.mean([f1(v) for v in crowd.values()]), np.mean(right))
        assert np.allclose((row["activity_f1"], row["overlap_f1"], row["primary_accuracy"]), want, atol=1e-8)
    assert [r["best"] for r in got].count(True) == 1 and max(got, key=P.rank)["best"]


WEIGHTS = {"a": 1.0, "b": 0.8, "c": 0.6}
TURNS = "recording_id string, system string, speaker_id string, start_ms long, end_ms long"
QUALITY = "recording_id string, system string, quality double"


def test_features_of_a_small_recording(spark):
    turns = [("r", "a", "x", 0, 1500), ("r", "b", "x", 0, 1000), ("r", "b", "y", 500, 1000), ("r", "c", "y", 2000, 2100), ("r", "c", "y", 2500, 2500), ("s", "c", "z", -50, 100)]
    cells = {tuple(r)[:3]: r for r in P.feature_cells(spark.createDataFrame(turns, TURNS), spark.createDataFrame([("r", "a", 0.5)], QUALITY), WEIGHTS, 1000, 400.0, "b").collect()}
    assert set(cells) == {("r", f, s) for f in (0, 1, 2) for s in "xy"} | {("s", 0, "z")}
    x, y = cells["r", 0, "x"], cells["r", 0, "y"]
    assert (x.a, x.b, x.c, x.a_b, x.anchor, x.a_quality, x.b_quality) == (1, 1, 0, 1, 1, 0.5, 0)
    assert x.agreement == 0.666667 and x.exclusive == 0 and y.exclusive == 0  # b hears two there
    assert cells["r", 1, "x"].a == 0.5 and cells["r", 1, "y"].anchor == 1 and cells["r", 2, "y"].c == 0.1 and cells["s", 0, "z"].anchor == 0
    ref = spark.createDataFrame([("r", "x", 0, 1200), ("r", "w", 0, 100)], "recording_id string, speaker_id string, start_ms long, end_ms long")
    table = P.feature_cells(spark.createDataFrame(turns, TURNS), spark.createDataFrame([], QUALITY), WEIGHTS, 1000, 400.0, "b")
    frames = {r.frame: [(c.speaker_id, c.share, c.valid) for c in r.cells] for r in P.labelled_frames(table, P.feature_names(list(WEIGHTS)), ref, 1000).collect()}
    assert frames == {0: [("x", 1, True), ("y", 0, False)], 1: [("x", 0.2, True), ("y", 0, False)], 2: [("x", 0, True), ("y", 0, False)]}


def test_empty_tables_and_lone_speakers(spark):
    turns, quality = spark.createDataFrame([], TURNS), spark.createDataFrame([], QUALITY)
    cells = P.feature_cells(turns, quality, WEIGHTS, 1000, 400.0, "b")
    assert cells.count() == 0 and P.speaker_prior(cells, WEIGHTS).count() == 0
    frames = P.labelled_frames(cells, P.feature_names(list(WEIGHTS)), turns.drop("system"), 1000)
    primary, heads = P.fit(frames, P.feature_names(list(WEIGHTS)))
    assert not primary.any() and all(not h.any() for h in heads)
    rows = P.threshold_sweep(frames, primary, heads[0])
    assert all(r["objective"] == 0 for r in rows) and rows[0]["best"]
    one = P.feature_cells(spark.createDataFrame([("r", "a", "x", 0, 1500)], TURNS), quality, WEIGHTS, 1000, 400.0, "b")
    assert [r.bias for r in P.speaker_prior(one, WEIGHTS).collect()] == [0.0]
    assert pytest.approx([1, 1]) == [r.primary for r in P.posteriors(one, dict.fromkeys(P.feature_names(list(WEIGHTS)), 1.0), {"a": 1.0}, 0.0).collect()]
