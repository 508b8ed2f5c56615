"""Blocked best paths, turn decoding under locks and anchors, and boundary relief against plain forms."""

import itertools
import random

import numpy as np
import pytest

from spanline.operators import decoding as D

BLOCKS = [1, 3, 512]


def plain_paths(rows, floor, stay_first):
    """All paths of one key: the best, ties by the last state first (stay_first: staying before that)."""
    names = sorted({s for _, scores, _, _ in rows for s, _ in scores})
    table = [dict(scores) for _, scores, _, _ in rows]
    whole = lambda x: round(x * 10**9)
    best = {s: (whole(table[0].get(s, floor)), [s]) for s in names if s in table[0] or floor is not None}
    for row, (_, _, stay, switch) in zip(table[1:], rows[1:], strict=True):
        after = {}
        for s in names:
            if s not in row and floor is None:
                continue
            ways = sorted(((-(v + (whole(stay) if q == s else -whole(switch))), stay_first and q != s, q) for q, (v, _) in best.items()))
            value, _, q = ways[0]
            after[s] = (-value + whole(row.get(s, floor)), [*best[q][1], s])
        best = after
    return min(best.items(), key=lambda x: (-x[1][0], x[0]))[1][1]


@pytest.mark.parametrize("block_steps", BLOCKS)
@pytest.mark.parametrize(("floor", "stay_first"), [(None, False), (0.0, True)])
def test_paths_do_not_depend_on_blocks(spark, block_steps, floor, stay_first):
    rng, rows = random.Random(11), []
    for key in range(12):
        for t in range(rng.randint(1, 40)):
            states = rng.sample("abcd", rng.randint(1, 4))
            rows.append((key, t * 3, [(s, rng.randint(0, 4) / 4) for s in states], rng.choice([0.0, 0.25]), rng.choice([0.0, 0.25, 0.5])))
    df = spark.createDataFrame(rows, "key int, t long, scores array<struct<state:string,score:double>>, stay double, switch double").repartition(3)
    got = {}
    for r in D.best_paths(df, floor, stay_first, block_steps).collect():
        got.setdefault(r.key, {})[r.t] = r.state
    for key in range(12):
        own = [r[1:] for r in rows if r[0] == key]
        assert [got[key][r[0]] for r in own] == plain_paths(own, floor, stay_first), key
    assert D.best_paths(df.limit(0), floor).count() == 0


def turn_rows(seed=2, keys=10):
    rng, rows = random.Random(seed), []
    for key in range(keys):
        at = 0
        for k in range(rng.randint(2, 14)):
            at += rng.choice([0, 100, 5_000])
            own, scores = rng.choice("ABCDE"), [(s, round(rng.choice([rng.uniform(-1, 1), 0.5]), 3)) for s in rng.sample("ABCDE", rng.randint(2, 5))]
            if rng.random() < 0.3:
                scores.append((own, 0.97))
            has = own in dict(scores)
            strong = has and rng.random() < 0.1
            locked = rng.choice("ABCZ") if not strong and rng.random() < 0.15 else None
            rows.append((key, f"t{k}", at, at + 800, own, locked, strong, scores))
            at += 800
    return rows


def plain_decode(rows, top, protect):
    """One recording's turns: dynamic programme over candidate sets, then speakers that are lost get a turn back."""
    rows = sorted(rows, key=lambda r: (r[2], r[3], r[1]))
    steps, facts = [], []
    for i, (_, turn, start, _, own, locked, strong, scores) in enumerate(rows):
        best = {}
        for s, p in scores:
            best[s] = max(p, best.get(s, -9))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
        margin = round(ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else -2.0), 12)
        sure = lambda a: ranked[0][0] == own and ranked[0][1] >= a[0] and margin >= a[1]  # noqa: B023, E731
        anchor = strong or (locked is None and sure(D.ANCHOR))
        allowed = [locked] if locked else [own] if anchor else list(dict.fromkeys([s for s, _ in ranked[:top]] + [own]))
        gap = max(0, start - rows[i - 1][3]) if i else 0
        near = np.exp(-gap / D.FADE_MS)
        steps.append((i, [(s, best.get(s, -2.0)) for s in allowed], D.STAY * near, D.SWITCH * near))
        facts.append((turn, own, locked in (None, own) and own in best, locked in (None, own) and sure(D.SUPPORT), best.get(own, -2.0), margin, start))
    path = plain_paths(steps, None, False)
    sure_turns, any_turns = {}, {}
    for i, f in enumerate(facts):
        if f[3]:
            sure_turns.setdefault(f[1], []).append(i)
        if f[2]:
            any_turns.setdefault(f[1], []).append(i)
    for s in sorted(sure_turns if protect == "supports" else any_turns if protect else ()):
        if s not in path:
            i = min(sure_turns.get(s, any_turns.get(s)), key=lambda i: (-facts[i][4], -facts[i][5], facts[i][6], facts[i][0]))
            path[i] = s
    return {f[0]: s for f, s in zip(facts, path, strict=True)}


SCHEMA = "key int, turn_id string, start_ms long, end_ms long, speaker_id string, locked string, strong boolean, scores array<struct<speaker_id:string,score:double>>"


@pytest.mark.parametrize("block_steps", BLOCKS)
@pytest.mark.parametrize(("top", "protect"), [(2, None), (2, "supports"), (3, "all")])
def test_turns_under_locks_and_anchors(spark, top, protect, block_steps):
    rows = turn_rows()
    got = {(r.key, r.turn_id): r.decoded for r in D.decode_turns(spark.createDataFrame(rows, SCHEMA).repartition(3), top=top, protect=protect, block_steps=block_steps).collect()}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        assert {t: s for (k, t), s in got.items() if k == key} == plain_decode(own, top, protect)
        for r in own:
            assert r[5] is None or got[key, r[1]] == r[5] or protect  # a lock holds, in the top or not


def test_turns_equal_all_sequences(spark):
    rows = [r for r in turn_rows(9, 4)]
    rows = [r for r in rows if int(r[1][1:]) < 6]
    got = {(r.key, r.turn_id): r.decoded for r in D.decode_turns(spark.createDataFrame(rows, SCHEMA), protect=None).collect()}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[2])

        def total(path):
            out = 0
            for i, (r, s) in enumerate(zip(own, path, strict=True)):
                best = {}
                for q, p in r[7]:
                    best[q] = max(p, best.get(q, -9))
                ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
                margin = ranked[0][1] - (ranked[1][1] if len(ranked) > 1 else -2)
                anchor = r[6] or (r[5] is None and ranked[0][0] == r[4] and ranked[0][1] >= 0.82 and round(margin, 12) >= 0.18)
                allowed = {r[5]} if r[5] else {r[4]} if anchor else {q for q, _ in ranked[:3]} | {r[4]}
                if s not in allowed:
                    return -1e9
                near = np.exp(-max(0, r[2] - own[i - 1][3]) / 1800) if i else 0
                out += best.get(s, -2.0) + (0 if not i else D.STAY * near if s == path[i - 1] else -D.SWITCH * near)
            return out

        best = max(total(p) for p in itertools.product("ABCDEZ", repeat=len(own)))
        assert abs(total([got[key, r[1]] for r in own]) - best) < 1e-7


@pytest.mark.parametrize("bad", [(None, "B", True, [("A", 0.5)]), (None, None, True, [("B", 0.5)]), (None, None, False, [])])
def test_contradictions_are_errors(spark, bad):
    df = spark.createDataFrame([(1, "t", 0, 10, "A", bad[1], bad[2], bad[3])], SCHEMA)
    with pytest.raises(Exception, match="lock contradicts|no score of its own|no scores"):
        D.decode_turns(df).collect()


def test_boundaries_and_relief(spark):
    rng = random.Random(5)
    turns = [(k, s, s + rng.randint(1, 3000), rng.choice("ab")) for k in (1, 2) for s in [rng.randint(0, 60_000) for _ in range(40)]] + [(1, 50, 51, "a")]
    frames = [(k, f) for k in (1, 2, 3) for f in range(0, 700)]
    weights = {"a": 1.0, "b": 0.5}
    got = {(r.key, r.frame): r.boundary for r in D.boundary_scores(spark.createDataFrame(frames, "key int, frame long"), spark.createDataFrame(turns, "key int, start_ms long, end_ms long, system string"), 100, 250.0, weights).collect()}
    for key in (1, 2):
        points = [(x, weights[s]) for k, a, b, s in turns if k == key for x in (a, b)]
        for f in range(700):
            want = sum(w * np.exp(-abs((f + 0.5) * 100 - x) / 250) for x, w in points) / sum(w for _, w in points)
            assert abs(got[key, f] - min(1, want)) < 2e-8
    assert got[3, 5] == 0


@pytest.mark.parametrize("block_steps", BLOCKS)
def test_frames_with_relief(spark, block_steps):
    rng = random.Random(6)
    p = [(k, f, s, rng.randint(0, 8) / 8) for k in ("x", "y") for f in sorted(rng.sample(range(90), 50)) for s in rng.sample("abc", rng.randint(1, 3))]
    near = [(k, f, rng.choice([0.0, 0.5, 1.0])) for k in ("x", "y") for f in range(90)]
    df, bounds = spark.createDataFrame(p, "recording_id string, frame long, speaker_id string, p double"), spark.createDataFrame(near, "recording_id string, frame long, boundary double")
    got = {(r.recording_id, r.frame): r.speaker_id for r in D.decode_frame_grid(df, bounds, 0.5, 0.125, 0.75, block_steps=block_steps).collect()}
    for key in ("x", "y"):
        own = [r for r in p if r[0] == key]
        first, last = min(r[1] for r in own), max(r[1] for r in own)
        rows = [(f, [("-", 0.34)] + [(r[2], r[3]) for r in own if r[1] == f], 0.125, max(0.0, 0.5 - 0.75 * dict((b[1], b[2]) for b in near if b[0] == key)[f])) for f in range(first, last + 1)]
        assert [got[key, f] for f in range(first, last + 1)] == plain_paths(rows, 0.0, True)
