"""Small hand cases and invariants of the operators without a SQL form."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanline.functions import text as X
from spanline.operators import clustering as K
from spanline.operators import diarization as D
from spanline.operators import hooks as H
from spanline.operators import intervals as I
from spanline.operators import review as R
from spanline.operators import scoring as S
from spanline.operators import windows as W
from spanline.sources import formats

TURNS = "event_id long, recording_id string, speaker_id string, start_ms long, end_ms long"


def turns(spark, seed, n=60):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        s = rng.randrange(0, 20_000)
        rows.append((k, f"r{k % 3}", rng.choice("abcd"), s, s + rng.randrange(1, 3_000)))
    return spark.createDataFrame(rows, TURNS), rows


def ticks(rows, rec):
    """Active speakers at each millisecond, by brute force."""
    out = {}
    for _, r, sp, s, e in rows:
        if r == rec:
            for t in range(s, e):
                out.setdefault(t, set()).add(sp)
    return out


def test_error_rates_equal_brute_force(spark):
    ref, a = turns(spark, 1)
    hyp, b = turns(spark, 2)
    got = {r.recording_id: r for r in D.diarization_error(ref, hyp).collect()}
    for rec in ("r0", "r1", "r2"):
        x, y = ticks(a, rec), ticks(b, rec)
        missed = sum(max(0, len(x.get(t, ())) - len(y.get(t, ()))) for t in x.keys() | y.keys())
        false = sum(max(0, len(y.get(t, ())) - len(x.get(t, ()))) for t in x.keys() | y.keys())
        wrong = sum(min(len(x[t]), len(y[t])) - len(x[t] & y[t]) for t in x.keys() & y.keys())
        assert (got[rec].missed_ms, got[rec].false_alarm_ms, got[rec].confusion_ms) == (missed, false, wrong)


def test_same_timeline_has_no_error_and_order_does_not_matter(spark):
    ref, rows = turns(spark, 3)
    again = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), TURNS).repartition(5)
    assert [r.der for r in D.diarization_error(ref, again).collect()] == [0.0] * 3
    assert [r.jer for r in D.jaccard_error(ref, again).collect()] == [0.0] * 3
    merged = I.merge_turns(ref)
    assert sorted(I.merge_turns(merged.drop("n_turns")).drop("n_turns").collect()) == sorted(merged.drop("n_turns").collect())


@pytest.mark.parametrize("bucket", [100, 1_000, 10**9])
def test_overlap_join_gives_each_pair_once(spark, bucket):
    a, x = turns(spark, 4)
    b, y = turns(spark, 5)
    got = sorted((r.event_id, r.r_event_id, r.overlap_ms) for r in I.overlap_join(a, b, bucket).collect())
    want = sorted((p[0], q[0], min(p[4], q[4]) - max(p[3], q[3])) for p in x for q in y if p[1] == q[1] and p[3] < q[4] and q[3] < p[4])
    assert got == want


def test_best_assignment_equals_permutations():
    rng = random.Random(1)
    for _ in range(40):
        n, m = rng.randint(1, 4), rng.randint(1, 5)
        w = [[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]
        total = sum(w[r][c] for r, c in D.best_assignment(w))
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        pick = lambda a, b: w[a][b] if n <= m else w[b][a]
        assert total == max(sum(pick(a, b) for a, b in zip(small, p)) for p in itertools.permutations(large, len(small)))


def test_relabel_uses_the_map(spark):
    ref, rows = turns(spark, 6)
    hyp = spark.createDataFrame([(i, r, {"a": "x", "b": "y", "c": "z", "d": "w"}[s], b, e) for i, r, s, b, e in rows], TURNS)
    mapped = D.relabel(hyp, D.optimal_map(I.overlap_matrix(ref, hyp)))
    assert [r.der for r in D.diarization_error(ref, mapped).collect()] == [0.0] * 3


def test_token_distance_equals_python(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    rows = [([rng.choice("abcdé") * rng.randint(1, 3) for _ in range(rng.randint(0, 12))], [rng.choice("abcdé") * rng.randint(1, 3) for _ in range(rng.randint(0, 12))]) for _ in range(50)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", X.token_distance("a", "b").alias("d"))
    assert all(r.d == distance(r.a, r.b) for r in df.collect())


def test_nfkc_and_tags(spark):
    df = spark.createDataFrame([("Ｆｕｌｌ　ＷＩＤＴＨ ﬁ ß", "ZH_hans_cn"), (None, "english"), ("", "EN")], "t string, tag string")
    got = df.select(X.normalized("t", latin_only=False).alias("n"), X.language_tag("tag").alias("tag")).collect()
    assert [tuple(r) for r in got] == [("full width fi ss", "zh-Hans-CN"), (None, None), ("", "en")]


def test_folds_walk_left_to_right(spark):
    rows = [("a", 1, 0, "s", 0, 1000, "one two"), ("b", 1, 1, "s", 1100, 2000, "one two"), ("c", 1, 2, "s", 1900, 3000, "wo three")]
    df = spark.createDataFrame(rows, "segment_id string, recording_id long, turn long, speaker_id string, start_ms long, end_ms long, text string")
    got = {r.segment_id: (r.start_ms, r.end_ms) for r in W.smooth_boundaries(df, 200, 200, 100).collect()}
    assert got == {"a": (0, 1050), "b": (1050, 1950), "c": (1950, 3000)}
    assert sorted(r.segment_id for r in W.dedup_text(df, 2).collect()) == ["a", "c"]
    assert [(r.segment_id, r.batch) for r in R.bounded_batches(df, 2, 100).orderBy("segment_id").collect()] == [("a", 0), ("b", 0), ("c", 1)]


def test_cue_pieces_join_back(spark):
    text = "Word, " * 60 + "x" * 300 + "\nend."
    df = spark.createDataFrame([(1, 0, 0, 60_000, text)], "recording_id long, turn long, start_ms long, end_ms long, text string")
    got = R.cues(df, 40).orderBy("number").collect()
    assert "".join(r.text for r in got) == text and all(len(r.text) <= 41 for r in got)
    assert got[0].start_ms == 0 and got[-1].end_ms == 60_000 and all(x.end_ms == y.start_ms for x, y in zip(got, got[1:]))


def test_auc_and_eer_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(round(rng.gauss(0.3 if same else 0.0, 0.2), 2), same) for same in [True] * 80 + [False] * 120]
    df = spark.createDataFrame(rows, "score double, same boolean")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(S.roc_auc(df).first().auc - auc) < 1e-8
    points = [(sum(n >= t for n in neg) / len(neg), sum(p < t for p in pos) / len(pos)) for t in [*sorted({s for s, _ in rows}), 9]]
    far, frr = min(points, key=lambda x: (round(abs(x[0] - x[1]), 12), round(sum(x), 12)))
    assert abs(S.eer_and_min_dcf(df).first().eer - (far + frr) / 2) < 1e-8
    m, s, a, b = S.platt(df)
    p = 1 / (1 + np.exp(-(a * (np.array([x for x, _ in rows]) - m) / s + b)))
    assert a > 0 and abs(p.mean() - 0.4) < 1e-3


def test_kmeans_finds_apart_groups_whatever_the_order(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(4)[:3]
    rows = [(k, (centres[k % 3] + 0.05 * rng.normal(size=4)).tolist()) for k in range(60)]
    for own in (rows, rows[::-1]):
        points = K.unit_vectors(spark.createDataFrame(own, "vec_id long, embedding array<double>"))
        got, _ = K.spherical_kmeans(points, 3)
        groups = {}
        for r in got.collect():
            groups.setdefault(r.vec_id % 3, set()).add(r.cluster)
        assert sorted(map(len, groups.values())) == [1, 1, 1] and len(set.union(*groups.values())) == 3


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(20):
        scores = rng.random((5, 3))
        score = lambda p: sum(scores[k, s] for k, s in enumerate(p)) - 0.4 * sum(x != y for x, y in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=5), key=score)
        assert abs(score(K.viterbi(scores, 0.4)) - score(best)) < 1e-12


def test_bad_lines_go_to_quarantine(spark):
    lines = ["SPEAKER r 1 0.5 1.25 <NA> <NA> a <NA> <NA>", "SPEAKER r 1 x 1 <NA> <NA> a", "", ";; note", "LEXEME r 1 0 1 <NA> <NA> a", "SPEAKER r 1 1.0 -1 <NA> <NA> a", "SPEAKER r 1 0.5 1.25 <NA> <NA> a <NA> <NA>"]
    good, bad = formats.parse_rttm(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in good.collect()] == [("r", "a", 500, 1750)] * 2 and bad.count() == 3
    turns_, issues = formats.parse_tagged(spark.createDataFrame([(1, "[a 0-1.5] hi [b 2-2] no [a 2-3] yes")], "id int, value string"))
    assert turns_.count() == 2 and issues.count() == 1


def test_adapter_problems_are_listed(spark):
    import pandas as pd

    H.register_adapter("half", lambda b: pd.DataFrame({"id": list(b["id"][b["id"] % 2 == 0]) + [99, 0], "y": 1}), "id long, y long")
    got, problems = H.run_adapter(spark.range(4).coalesce(1), "half")
    assert {(r.id, r.code) for r in problems.collect()} == {(1, "MISSING"), (3, "MISSING"), (99, "UNEXPECTED"), (0, "REPEATED")}
    with pytest.raises(ValueError):
        H.per_group(spark.range(5).withColumn("g", F.lit(1)), ["g"], lambda p: p, "id long, g int", 3)


def test_decisions_apply_last_and_count_repeats_once(spark):
    seg = spark.createDataFrame([("s1", "raw one"), ("s2", "raw two"), ("s3", "raw three")], "segment_id string, text string")
    dec = spark.createDataFrame([("d1", 1, "s1", "edit", "new"), ("d1", 1, "s1", "edit", "new"), ("d2", 2, "s1", "accept", None), ("d3", 3, "s2", "reject", None)], "decision_id string, seq int, segment_id string, action string, text string")
    got = {r.segment_id: (r.display_text, r.action, r.n_revisions) for r in R.apply_decisions(seg, dec).collect()}
    assert got == {"s1": ("raw one", "accept", 2), "s2": (None, "reject", 1), "s3": ("raw three", "none", 0)}


@pytest.mark.parametrize("block_rows", [37, 8_192])
def test_leader_groups_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    vectors = np.concatenate([centres[rng.integers(0, 40, 260)] + rng.normal(size=(260, 64)) * 0.55, np.zeros((2, 64))])
    vectors[200:230] = vectors[5]  # equal ones
    ids = rng.permutation(len(vectors)).tolist()
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    near, label = unit @ unit.T >= 0.72, np.array(ids)
    np.fill_diagonal(near, True)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    points = K.unit_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>").repartition(3))
    got = {r.vec_id: r.label for r in K.leader_groups(points, 0.72, block_rows).collect()}
    assert got == dict(zip(ids, label.tolist())) and 20 < len(set(got.values())) < 200
