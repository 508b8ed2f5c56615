"""What the findings of round 4 were about: small cases that failed before, or took a table of pairs."""

import math
import random
import time
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from spanline.functions import text as X
from spanline.operators import evidence as E
from spanline.operators import intervals as I
from spanline.operators import review as R
from spanline.operators import windows as W
from spanline.streaming import jobs as J


def test_decisions_of_two_segments_may_share_an_id(spark):
    seg = spark.createDataFrame([("0-1", "x"), ("1000-0", "y"), ("7-0", "z")], "segment_id string, text string")
    dec = spark.createDataFrame([("d1000", "0-1", 1, "accept", None), ("d1000", "1000-0", 10000, "edit", "new"), ("d1000", "1000-0", 10000, "edit", "new")], "decision_id string, segment_id string, seq long, action string, text string")
    got = {r.segment_id: (r.display_text, r.action, r.n_revisions) for r in R.apply_decisions(seg, dec).collect()}
    assert got == {"0-1": ("x", "accept", 1), "1000-0": ("new", "edit", 1), "7-0": ("z", "none", 0)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def turns(spark, seed, n=80, last=20_000, longest=3_000):
    rng = random.Random(seed)
    rows = [(k, f"r{k % 3}", rng.choice("abcd"), s, s + rng.randrange(1, longest)) for k in range(n) for s in [rng.randrange(0, last)]]
    return spark.createDataFrame(rows, "event_id long, recording_id string, speaker_id string, start_ms long, end_ms long"), rows


def test_overlap_flags_read_each_turn_once(spark):
    df, rows = turns(spark, 4, last=60_000)
    got = I.overlap_flags(df)
    assert "unboundedfollowing" not in plan(got)  # Spark computes such a frame anew for each row
    for r in got.collect():
        assert r.overlapped == any(i != r.event_id and rec == r.recording_id and s < r.end_ms and r.start_ms < e for i, rec, _, s, e in rows)


def test_window_statistics_are_exact(spark):
    rng = random.Random(8)
    values = {who: [rng.choice([None, 1.0, rng.uniform(0, 500)]) for _ in range(n)] for who, n in (("a", 30_001), ("b", 20), ("c", 1))}
    rows = [(datetime(2024, 1, 1) + timedelta(seconds=k), who, v) for who, own in values.items() for k, v in enumerate(own)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double").repartition(5)
    got = {r.event_type: (r.n, r.p50, r.p95) for r in J.exact_stats(J.window_values(df)).collect()}
    for who, own in values.items():
        own.sort(key=lambda v: -1 if v is None else v)
        assert got[who] == (len(own), *[own[max(1, -(-len(own) * p // 100)) - 1] for p in (50, 95)])


def test_many_points_match_in_time_that_grows_with_them():
    rng = np.random.default_rng(9)
    for n, m in ((1, 1), (5, 9), (9, 5), (40, 40), (7, 60)):
        for _ in range(60):
            a, b = (np.sort(rng.choice(80, k, replace=False)) for k in (n, m))
            few, many = sorted((a.tolist(), b.tolist()), key=len)
            row = [0] * (len(many) + 1)
            for x in few:
                best, new = math.inf, [math.inf]
                for y, before in zip(many, row, strict=False):
                    new.append(best := min(best, before + abs(x - y)))
                row = new
            i, j = E.matched_in_order(a, b)
            assert len(set(i)) == len(set(j)) == len(few) and np.abs(a[i] - b[j]).sum() == row[-1]
    a, b = (np.unique(rng.integers(0, 86_400_000, k)) for k in (150_000, 140_000))  # a table of 21,000,000,000 cells
    i, j = E.matched_in_order(a, b)
    assert len(j) == len(b) and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()


def test_pieces_take_the_speaker_that_most_turns_have(spark):
    df, rows = turns(spark, 5, n=60)
    hyp, others = turns(spark, 6, n=50, last=14_000)
    got = sorted((r.event_id, r.start_ms, r.end_ms, r.speaker_id) for r in E.project_turns(df, hyp).collect())
    want = []
    for i, rec, _, s, e in rows:
        own = [(sp, a, b) for _, r, sp, a, b in others if r == rec and a < e and s < b]
        cuts = sorted({s, e, *[x for _, a, b in own for x in (a, b) if s < x < e]})
        for a, b in zip(cuts, cuts[1:]):
            n = Counter(sp for sp, x, y in own if x < b and a < y)
            want.append((i, a, b, max(n, key=lambda sp: (n[sp], sp)) if n else None))
    assert got == sorted(want)
    for bucket in (1_000, 7_000):
        assert sorted(E.leading_speakers(hyp, bucket).collect()) == sorted(E.leading_speakers(hyp).collect())


def test_best_markers_need_no_pairs(spark):
    rng = random.Random(12)
    points = [(r, rng.randrange(0, 30_000)) for r in "ab" for _ in range(80)]
    marks = [(r, rng.randrange(0, 30_000), rng.randrange(1, 3), rng.randrange(0, 4) / 4) for r in "ac" for _ in range(90)] + [("b", 29_000, 1, 0.5)]
    df, own = spark.createDataFrame(points, "recording_id string, t long"), spark.createDataFrame(marks, "recording_id string, m long, priority long, confidence double")
    want = {}
    for r, t in points:
        near = [(-round(0.75 * (1 - abs(t - m) / 2000) + 0.25 * c, 9), abs(t - m), -p, m) for q, m, p, c in marks if q == r and abs(t - m) <= 2000]
        if near:
            want[r, t] = (min(near)[3], -min(near)[0])
    for bucket in (1_000, 5_000, 100_000):
        out = E.best_markers(df, own, 2000, bucket)
        assert "Join" not in plan(out)
        assert {(x.recording_id, x.t): (x.m, x.score) for x in out.collect()} == want


def test_common_time_of_kinds_needs_no_pairs(spark):
    (left, a), (right, b) = turns(spark, 7), turns(spark, 8)
    out = I.common_time(left, right, "speaker_id")
    want = {}
    for _, r, k, s, e in a:
        for _, q, o, x, y in b:
            if q == r and s < y and x < e:
                ms, old = min(e, y) - max(s, x), want.get((r, k), (0, 0))
                want[r, k] = (old[0] + ms, old[1] + ms * (k == o))
    assert {(x.recording_id, x.speaker_id): (x.common_ms, x.equal_ms) for x in out.collect()} == want


@pytest.mark.parametrize("least", [1, 900])
def test_speaker_windows_need_no_pairs(spark, least):
    df, rows = turns(spark, 9)
    want = {}
    for r, s in {(r, s) for _, r, _, s, _ in rows}:
        ms = Counter()
        for _, q, who, x, y in rows:
            if q == r and x < s + 2500 and s < y:
                ms[who] += min(y, s + 2500) - max(x, s)
        ms = [x for x in ms.values() if x >= least]
        if ms:
            want[r, s] = (len(ms), min(ms), sum(ms))
    for bucket in (700, 4_000, 1_000_000):
        out = W.speaker_windows(df.select("recording_id", "start_ms"), df, 2500, least, bucket)
        assert "Join" not in plan(out)
        assert {(x.recording_id, x.start_ms): (x.n, x.least_ms, x.speech_ms) for x in out.collect()} == want


def full_table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_steps_in_a_band_equal_the_full_table(monkeypatch):
    for name, value in (("WHOLE", 8), ("STRIDE", 3)):
        monkeypatch.setattr(X, name, value)
    rng = random.Random(14)
    for _ in range(600):
        letters = "abcdef"[: rng.randint(1, 6)]
        a = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        b = [x for x in a if rng.random() > 0.2] if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        assert X.edit_steps(a, b) == X.edit_steps("".join(a), "".join(b)) == full_table(a, b)
        for held in (1, 100, 10_000):
            s, n, d = E.edit_counts(a, b, held)
            assert s + n + d == full_table(a, b) and n - d == len(b) - len(a)


def test_long_lists_of_words_in_seconds(spark):
    words = [f"w{k * k % 9_973}" for k in range(20_000)]
    others = [w for k, w in enumerate(words, 1) if k % 7]
    df = spark.createDataFrame([(words, others)], "a array<string>, b array<string>")
    start = time.monotonic()
    got = df.select(X.token_distance("a", "b").alias("d"), E.edit_count_column("a", "b").alias("c")).first()
    assert got.d == 20_000 // 7 and tuple(got.c) == (0, 0, 20_000 // 7)
    assert time.monotonic() - start < 15  # Spark's levenshtein and a row of the table at a time visit 343,000,000 cells


def test_timeline_context_makes_no_pairs(spark, monkeypatch):
    df, rows = turns(spark, 15, last=9_000)
    rows += [(900, "r9", "a", 5, 9), (901, "r9", "b", 9, 12), (902, "r8", "a", 0, 50), (903, "r8", "c", 0, 50), (904, "r8", "b", 0, 1)]
    df = spark.createDataFrame(rows, df.schema).repartition(3)
    want = {}
    for i, r, _, s, e in rows:
        near = sorted((x, j, who) for j, q, who, x, y in rows if q == r and j != i and x < e and s < y)
        if near:
            want[i] = (len(near), ",".join(f"{who}:{x}" for x, _, who in near))
    monkeypatch.setattr(E, "CONTEXT_CHARS", 500)
    for bucket in (700, 5_000, 1_000_000):
        assert {x.event_id: (x.n_context, x.context) for x in E.timeline_context(df, bucket).collect()} == want


def test_word_times_come_from_running_lengths(spark):
    words = ["a", "", "été", *["word"] * 2_000]
    df = spark.createDataFrame([(1, "a", 0, 100, 90_100, words), (1, "b", 1, 0, 10, None)], "recording_id long, speaker_id string, turn long, start_ms long, end_ms long, words array<string>")
    start = time.monotonic()
    got = {r.speaker_id: r.words for r in E.timed_words(df).collect()}
    assert time.monotonic() - start < 20  # some seconds for each thousand words if each adds up all before it
    assert got["b"] is None
    upto, all_ = 0, sum(max(len(w), 1) for w in words)
    for w, x in zip(words, got["a"], strict=True):
        assert (x.w, x.a) == (w, 100 + 90_000 * upto / all_)
        upto += max(len(w), 1)
        assert x.b == 100 + 90_000 * upto / all_
    assert "aggregate" not in plan(E.timed_words(df))


def test_words_far_from_all_points_are_left_out():
    assert E.constrained_distance(["x", "y"], [0, 100], [10, 110], ["x", "y"], [5, 900], 3) == 2
    assert E.constrained_distance(["x"], [0], [10], [], [], 3) == 1 and E.constrained_distance(["x"], [0], [10], ["x"], [13], 3) == 0
    assert E.constrained_distance(["x"], [0], [10], ["x"], [14], 3) == 2 and E.constrained_distance(["x"], [5], [10], ["x"], [2], 3) == 0
