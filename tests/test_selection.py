"""Greedy selections against plain loops, and the number of jobs they take."""

import hashlib
import random
from collections import Counter

import pytest

from spanline.operators import selection as S


def cases_of(n, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice("abcdefgh"), rng.choice(["en", "de", "fr"]), rng.randint(1, 6), rng.randint(10, 5000), rng.random() < 0.4, sorted(rng.sample([f"s{i}" for i in range(300)], rng.randint(0, 3)))) for k in range(n)]


def features(c):
    _, source, language, speakers, n, eligible, scenarios = c
    return {f"source:{source}", f"language:{language}", f"speakers:{'one' if speakers <= 1 else 'few' if speakers <= 3 else 'many'}", f"size:{'short' if n < 500 else 'medium' if n < 2000 else 'long'}", f"truth:{'yes' if eligible else 'no'}", *(f"scenario:{s}" for s in scenarios)}


def greedy(cases, most):
    count = Counter(f for c in cases for f in features(c))
    covered, picked, left = set(), [], {c[0]: features(c) for c in cases}
    while left and len(picked) < most:
        best = min(left, key=lambda c: (-round(sum(1 / count[f] for f in left[c] - covered), 12), c))
        covered |= left.pop(best)
        picked.append(best)
    return picked


CASES = "case_id long, source string, language string, speaker_count int, n_chars int, truth_eligible boolean, scenarios array<string>"


@pytest.mark.parametrize(("n", "most", "page"), [(200, 6, 7), (200, 60, 50), (40, 60, 20_000), (1500, 1000, 20_000)])
def test_diverse_cases_equal_the_plain_greedy(spark, n, most, page):
    cases = cases_of(n)
    df = spark.createDataFrame(cases, CASES).repartition(3)
    group = f"diverse-{n}-{most}-{page}"
    spark.sparkContext.setJobGroup(group, group)
    got = sorted(tuple(r) for r in S.diverse_cases(df, most, page).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == list(enumerate(greedy(cases, most)))
    assert page < n or jobs < 20
    assert S.diverse_cases(df.limit(0), 3).count() == 0


def disputes(n=600, seed=3):
    rng = random.Random(seed)
    return [(f"t{k}", rng.random() < 0.5, rng.random() < 0.5, rng.randint(0, 50) / 50, rng.randint(0, 50) / 50, rng.choice(["0-0", "0-1", "1-2"]), [str(rng.randint(0, 9)), str(rng.randint(0, 9))]) for k in range(n)]


def picked_plainly(rows, count, seed):
    target, taken, genres, people, out = count // 6, set(), Counter(), Counter(), []
    sha = lambda *x: hashlib.sha256(":".join(map(str, x)).encode()).hexdigest()
    for bucket, (disputed, measure, ascending, size) in S.BUCKETS.items():
        start = set(taken)
        for same in (True, False):
            key = lambda r: (r[3] if measure == "conflict" else r[4]) * (1 if ascending else -1)  # noqa: B023, E731
            pool = sorted((r for r in rows if r[1] == same and (r[2] or not disputed) and r[0] not in start), key=lambda r: (key(r), sha(seed, r[0])))[: target * size]
            for offset in range(target):
                best = min((r for r in pool if r[0] not in taken), key=lambda r: (genres[r[5]], sum(people[s] for s in r[6]), key(r), sha(seed, bucket, same, offset, r[0])))
                taken.add(best[0])
                genres[best[5]] += 1
                people.update(best[6])
                out.append((len(out), bucket, best[0], same))
    return out


@pytest.mark.parametrize("count", [6, 36])
def test_disputes_keep_quotas(spark, count):
    rows = disputes()
    df = spark.createDataFrame(rows, "case_id string, same boolean, disagreement boolean, conflict double, nearness double, genre string, speakers array<string>").repartition(3)
    got = sorted(tuple(r) for r in S.balanced_disputes(df, count, "x").collect())
    assert got == picked_plainly(rows, count, "x")
    assert Counter((b, s) for _, b, _, s in got) == {(b, s): count // 6 for b in S.BUCKETS for s in (True, False)}
    with pytest.raises(Exception, match="too few"):
        S.balanced_disputes(df.where("same").unionByName(df.where("NOT same").limit(2)), count * 2, "x").collect()
    with pytest.raises(ValueError, match="multiple"):
        S.balanced_disputes(df, 7, "x")


def windows_plainly(frames, duration, size, seed, key, n_random=2, n_change=3):
    active = [f for f in frames if f[2]]
    if not active or duration < size:
        return []
    clip, mid = (lambda s: max(0, min(duration - size, s))), (lambda f: (f[0] + f[1]) // 2)
    at, out = (lambda f: clip(mid(f) - size // 2)), []
    first, last = min(f[0] for f in active), max(f[1] for f in active)
    middle = min(active, key=lambda f: (abs(mid(f) - duration // 2), f[0], at(f)))
    for reason, start in (("start", clip(first - size // 10)), ("middle", at(middle)), ("end", clip(last - size * 9 // 10))):
        if start not in [s for _, s in out]:
            out.append((reason, start))
    chance = lambda f: hashlib.sha256(f"{seed}:{key}:{f[0]}:{f[1]}".encode()).hexdigest()
    for kind, number, order in (("random", n_random, lambda f: (chance(f), f[0])), ("change", n_change, lambda f: (-f[3], f[0], at(f)))):
        k = 1
        for f in sorted(active, key=order):
            if k <= number and all(abs(at(f) - s) >= size // 2 for _, s in out):
                out.append((f"{kind}-{k}", at(f)))
                k += 1
    return [(r, s, [f for f in frames if s <= mid(f) < s + size]) for r, s in out]


def test_stratified_windows_equal_the_plain_form(spark):
    rng, frames, spans = random.Random(4), [], []
    for key in ("a", "b", "c", "d", "e"):
        spans.append((key, 200_000 if key != "d" else 9_000))
        for s in sorted(rng.sample(range(0, 198_000 if key != "d" else 8_000), 60 if key != "e" else 3)):
            frames.append((key, s, s + rng.randint(1, 2000), rng.random() < 0.5 and key != "c", rng.randint(0, 20) / 20))
    df = spark.createDataFrame(frames, "recording_id string, start_ms long, end_ms long, active boolean, change double").repartition(3)
    got = {}
    for r in S.stratified_windows(df, spark.createDataFrame(spans, "recording_id string, duration_ms long"), 20_000, "w").collect():
        got.setdefault(r.recording_id, {})[r.reason, r.start_ms] = (r.active_ratio, r.mean_change, r.max_change)
    for key, duration in spans:
        want = windows_plainly([f[1:] for f in frames if f[0] == key], duration, 20_000, "w", key)
        rate = lambda x: round(sum(x) / len(x), 9) if x else 0.0
        assert got.get(key, {}) == {(r, s): (rate([f[2] for f in own]), rate([f[3] for f in own]), max([f[3] for f in own], default=0.0)) for r, s, own in want}, key
    assert "c" not in got and "d" not in got and len(got["a"]) > 5
