"""Locks, stability, choice of a count and merging under a veto against plain forms."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from spanline.operators import clustering as K
from spanline.operators import sampling as P


def points_of(spark, x, locks=None):
    rows = [(k, (v / np.linalg.norm(v)).tolist(), (locks or {}).get(k)) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, v array<double>, lock int").repartition(3)


def blobs(sizes, seed=1, spread=0.05, dims=8):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=dims) + rng.normal(size=(n, dims)) * spread for n in sizes])


def test_locks_hold_and_seed_their_clusters(spark):
    x = blobs([20, 20, 20])
    locks = {0: 1, 1: 1, 25: 0, 45: 0}  # 25 and 45 are of different blobs and stay together
    own, centres = K.spherical_kmeans(points_of(spark, x, locks), 3)
    got = {r.vec_id: r.cluster for r in own.collect()}
    assert all(got[k] == c for k, c in locks.items()) and len(set(got.values())) == 3 and len(centres) == 3
    assert len({got[k] for k in range(20)}) == 1
    with pytest.raises(ValueError, match="locks"):
        K.spherical_kmeans(points_of(spark, x, {0: 2}), 3)
    with pytest.raises(ValueError, match="fewer points"):
        K.spherical_kmeans(points_of(spark, x[:2], {0: 0, 1: 1}), 3)


def pair_measures(a, b):
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in combinations(range(len(a)), 2))
    one, other, pairs = (sum(x[i] == x[j] for i, j in combinations(range(len(a)), 2)) for x in (a, b)), None, len(a) * (len(a) - 1) // 2
    one, other = tuple(one)
    expected = one * other / pairs
    return (both - expected) / ((one + other) / 2 - expected), both / (one + other - both), 1 - (one + other - 2 * both) / pairs


def test_agreement_equals_pairs_and_all_maps(spark):
    from itertools import permutations

    rng = random.Random(2)
    a = [rng.randint(0, 3) for _ in range(60)]
    b = [(x + (rng.random() < 0.3) * rng.randint(1, 3)) % 4 + 10 for x in a]
    want = (*pair_measures(a, b), max(sum(b[i] == p[a[i]] for i in range(60)) for p in permutations(range(10, 14))) / 60)
    got = P.partition_agreement(spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int").repartition(3)).first()
    assert np.allclose([got.adjusted_rand, got.jaccard, got.coassociation, got.aligned_accuracy], want, atol=1e-8)
    own = K.agreement(Counter(zip(a, b, strict=True)))
    assert np.allclose([own[m] for m in ("adjusted_rand", "jaccard", "coassociation", "aligned_accuracy")], want, atol=1e-8)


def test_stability_does_not_depend_on_the_order_of_rows(spark):
    x = blobs([15, 12, 9], spread=0.4)
    points = points_of(spark, x, {0: 0})
    out = []
    for df in (points, points.orderBy("v").repartition(5)):
        own, centres = K.spherical_kmeans(df, 3)
        out.append(K.stability(df, own, centres, runs=3))
    assert out[0] == out[1] and len({tuple(r.items()) for r in out[0]}) == 3
    tight = points_of(spark, blobs([15, 12, 9], spread=0.01))
    own, centres = K.spherical_kmeans(tight, 3)
    assert all(r["stability"] == 1 and r["coverage"] == 1 for r in K.stability(tight, own, centres, runs=2))


def chosen(df):
    rows = df.collect()
    return next((r.k, r.reason) for r in rows if r.chosen), rows


def test_count_is_found_and_a_lone_point_makes_no_speaker(spark):
    (k, _), rows = chosen(K.choose_count(points_of(spark, blobs([12, 12, 12], seed=3)), range(2, 5), runs=2))
    assert k == 3 and len(rows) == 3 and sum(r.chosen for r in rows) == 1
    x = np.concatenate([blobs([14, 14], seed=5, spread=0.01), blobs([1], seed=77)])
    (k, reason), rows = chosen(K.choose_count(points_of(spark, x), range(2, 4), runs=2))
    assert k == 2 and rows[1].singletons == 1


def test_steps_of_counts():
    base = {"k": 2, "singletons": 0, "tiny": 0, "least_size": 9, "compactness": 0.95, "residual": 0.05, "stability": 0.97, "silhouette": 0.5}
    lone = base | {"k": 3, "singletons": 1, "tiny": 1, "least_size": 1, "stability": 0.95}
    assert K.lone_outlier(base, lone) and not K.lone_outlier(base | {"residual": 0.3}, lone) and not K.lone_outlier(base, lone | {"least_size": 2, "singletons": 0})
    near = base | {"k": 3, "residual": 0.005, "compactness": 0.995, "silhouette": 0.6}
    assert K.close_voices(base, near) and not K.close_voices(base, near | {"residual": 0.02}) and not K.close_voices(base, near | {"stability": 0.8})


def test_bounds_of_counts():
    assert list(K.count_bounds(9, "manual", 4)) == [4] and list(K.count_bounds(9, most_auto=5)) == [1, 2, 3, 4, 5]
    assert list(K.count_bounds(9, "hybrid", 2, 4, locks=3)) == [3, 4] and list(K.count_bounds(3, "hybrid", 2, 8)) == [2, 3]
    for bad in [(3, "manual", 4), (9, "manual", 2, None, 3), (9, "hybrid", 5, 4), (9, "auto", None, None, 6, 5)]:
        with pytest.raises(ValueError, match="no count"):
            K.count_bounds(*bad)


def merged_plainly(pairs, conflicts, least):
    """Rounds of mutual best partners over one recording, with sets of members."""
    groups = {m: {m} for p in [*pairs, *conflicts] for m in p[:2]}
    while True:
        label = {m: min(g) for g in groups.values() for m in g}
        scores = {}
        for a, b, s in pairs:
            if label[a] != label[b]:
                scores.setdefault(frozenset((label[a], label[b])), []).append(s)
        apart = {frozenset((label[a], label[b])) for a, b in conflicts}
        open_ways = {p: round(sum(s) / len(s), 9) for p, s in scores.items() if p not in apart and round(sum(s) / len(s), 9) >= least}
        best = {}
        for p, s in sorted(open_ways.items(), key=lambda x: x[1]):
            for g in p:
                best[g] = next(iter(p - {g}))
        pairs_now = {frozenset((g, o)) for g, o in best.items() if best.get(o) == g}
        if not pairs_now:
            return label
        for p in pairs_now:
            x, y = sorted(p)
            groups[x] = groups[x] | groups.pop(y)


def test_merging_under_a_veto(spark):
    rng, pairs, conflicts, spans = random.Random(8), [], [], {}
    for key in "pqr":
        spans[key] = {m: (s := rng.randint(0, 100), s + rng.randint(5, 30)) for m in range(12)}
        for a, b in combinations(range(12), 2):
            if rng.random() < 0.6:
                pairs.append((key, a, b, rng.random()))
            if spans[key][a][0] < spans[key][b][1] and spans[key][b][0] < spans[key][a][1]:
                conflicts.append((key, a, b))
    p, c = spark.createDataFrame(pairs, "key string, a long, b long, score double").repartition(3), spark.createDataFrame(conflicts, "key string, a long, b long")
    got = {(r.key, r.member): r.label for r in K.merge_runs(p, 0.4, c).collect()}
    free = {(r.key, r.member): r.label for r in K.merge_runs(p, 0.4).collect()}
    for key in "pqr":
        own, veto = [x[1:] for x in pairs if x[0] == key], [x[1:] for x in conflicts if x[0] == key]
        label = merged_plainly(own, veto, 0.4)
        assert {m: got[key, m] for m in label} == label and {m: free[key, m] for m in range(12) if (key, m) in free} == {m: x for m, x in merged_plainly(own, [], 0.4).items()}
        assert not any(got[key, a] == got[key, b] for a, b in veto) and len(set(label.values())) < 12
