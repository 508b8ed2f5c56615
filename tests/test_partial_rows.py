"""Two-level percentiles, the island guard, chunk overlap, system quality, late rows and sketches against plain forms."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from spanline.operators import clustering as K
from spanline.operators import review as R
from spanline.operators import scoring as S
from spanline.operators import windows as W
from spanline.streaming import jobs as J


@pytest.mark.parametrize("cells", [1, 3, 1024])
def test_percentiles_equal_numpy(spark, cells):
    rng = random.Random(1)
    rows = [(k, v) for k in ("a", "b", None) for v in [rng.choice([rng.uniform(-5, 5), 2.5, 1e9, None]) for _ in range(120)]] + [("one", 7.0), ("none", None), *[("same", 3.0)] * 9]
    got = {r.k: (r.p0, r.p37, r.p95, r.p1) for r in S.percentiles(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", {"p0": 0.0, "p37": 0.37, "p95": 0.95, "p1": 1.0}, cells).collect()}
    values = {k: [v for q, v in rows if q == k and v is not None] for k, _ in rows}
    assert set(got) == {k for k, v in values.items() if v}
    for k, own in got.items():
        assert np.allclose(own, np.percentile(values[k], [0, 37, 95, 100]), rtol=1e-12)


def repaired_plainly(rows, most, gap, strong):
    rows = sorted(rows, key=lambda r: (r[2], r[3], r[1]))
    count, out, isle = Counter(r[4] for r in rows), {}, set()
    for i in range(1, len(rows) - 1):
        if rows[i - 1][4] == rows[i + 1][4] != rows[i][4]:
            isle.add(i)
    for i, (_, name, start, end, speaker, margin, locked, over, conflict, top) in enumerate(rows):
        if i not in isle:
            out[name] = (speaker, "NONE", [])
            continue
        left, right = rows[i - 1], rows[i + 1]
        if margin >= strong:
            out[name] = (speaker, "STRONG", [])
            continue
        found = [n for n, c in (
            ("DURATION", end - start > most), ("OVERLAP", left[3] > start or end > right[2]), ("GAP", max(0, start - left[3], right[2] - end) > gap), ("ADJACENT", i - 1 in isle or i + 1 in isle), ("LOCKED", locked),
            ("OVERLAPPING", over), ("NEIGHBOUR_OVERLAPPING", left[7] or right[7]), ("BOUNDARY", conflict), ("NOT_IN_TOP", left[4] not in top),
        ) if c]
        if not found and count[speaker] <= 1:
            found = ["LAST_SUPPORT"]
        if found:
            out[name] = (speaker, "REVIEW", found)
        else:
            count[speaker] -= 1
            count[left[4]] += 1
            out[name] = (left[4], "APPLIED", [])
    return out


def test_islands_keep_a_last_support(spark):
    rng, rows = random.Random(2), []
    for key in range(40):
        at = 0
        for k in range(rng.randint(1, 25)):
            at += rng.choice([0, 0, 0, 0, 900, -50])
            length = rng.choice([300, 400, 400, 5000])
            speaker = "A" if k % 2 == 0 and rng.random() < 0.8 else rng.choice("ABCD")
            rows.append((key, f"s{k:02}", at, at + length, speaker, rng.choice([0.0, 0.0, 0.0, 0.9]), *[rng.random() < 0.04 for _ in range(3)], rng.sample("ABCD", 3)))
            at += length
    df = spark.createDataFrame(rows, "recording_id int, segment_id string, start_ms long, end_ms long, speaker_id string, margin double, locked boolean, overlapping boolean, boundary_conflict boolean, top array<string>").repartition(3)
    got = {}
    for r in W.repair_islands(df, 1000, 500, 0.5).collect():
        got.setdefault(r.recording_id, {})[r.segment_id] = (r.fixed, r.verdict, r.blockers)
    verdicts = Counter()
    for key in {r[0] for r in rows}:
        want = repaired_plainly([r for r in rows if r[0] == key], 1000, 500, 0.5)
        assert got[key] == want
        verdicts.update(b for _, _, x in want.values() for b in x)
        verdicts.update(v for _, v, _ in want.values())
        assert {r[4] for r in rows if r[0] == key} == {f for f, _, _ in got[key].values()}
    assert verdicts["LAST_SUPPORT"] and verdicts["APPLIED"] and verdicts["STRONG"] and verdicts["ADJACENT"]


def test_chunks_repeat_their_last_lines(spark):
    texts = [(1, "\n".join(["x" * n for n in (5, 9, 30, 2, 3, 4, 50, 1)])), (2, ""), (3, None), (4, "y" * 100)]
    got = sorted(tuple(r) for r in R.text_chunks(spark.createDataFrame(texts, "doc_id int, text string"), 20, 12).collect())
    plain = [x for x in got if not x[4]]
    assert [(x[1], x[2]) for x in plain if x[0] == 1] == [(0, 0), (1, 0), (2, 0), (3, 2), (4, 2), (5, 2), (6, 2), (7, 5)]
    assert [x[1:4] for x in got if x[4]] == []  # the last lines of both chunks are longer than the overlap
    got = sorted(tuple(r) for r in R.text_chunks(spark.createDataFrame(texts, "doc_id int, text string"), 16, 12).collect())
    want = {}
    before = 0
    for k, n in enumerate((5, 9, 30, 2, 3, 4, 50, 1)):
        want.setdefault(before // 16, []).append((k, n))
        before += n + 1
    again = []
    for chunk, following in zip(list(want), list(want)[1:], strict=False):
        room = 12
        for k, n in reversed(want[chunk]):
            room -= n + 1
            if room < 0:
                break
            again.append((1, k, following, n, True))
    assert [x for x in got if x[4]] == sorted(again) and again


def test_quality_of_systems(spark):
    grid = [("r", "a", f, "x") for f in range(10)] + [("r", "b", f, "x") for f in range(5)] + [("r", "b", 9, "y")] + [("q", "a", 0, "x")]
    turns = [("r", "a", "x", 0, 10_000), ("r", "b", "x", 0, 5_000), ("r", "b", "y", 9_000, 9_500), ("q", "a", "x", 0, 900)]
    df = spark.createDataFrame(grid, "recording_id string, system string, frame long, speaker_id string")
    got = {(r.recording_id, r.system): (r.agreement, r.coverage, r.quality) for r in K.system_quality(df, spark.createDataFrame(turns, "recording_id string, system string, speaker_id string, start_ms long, end_ms long"), 10).collect()}
    minutes = 10 / 60

    def quality(agree, lonely, short, turns, off, unlike):
        return round((0.48 * agree + 0.16 * (1 - lonely) + 0.14 * (1 - short) + 0.1 * (1 - min(1, turns / minutes / 28)) + 0.12 * (1 - off)) * max(0.45, 1 - 0.5 * unlike), 6)

    assert got["r", "a"] == (0.5, 1.0, quality(0.5, 0.5, 0, 1, 0, min(1, 0.4 / 0.65)))
    assert got["r", "b"] == (round(5 / 6, 9), 0.6, quality(5 / 6, 1 / 6, 0.5, 2, 1, min(1, 0.4 / 1.05)))
    assert got["q", "a"][2] == quality(0.5, 0, 0, 1, 0, 0)


def events(spark, rows):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + timedelta(hours=h), who, v) for i, (h, who, v) in enumerate(rows)], "event_id long, ts timestamp, event_type string, value double")


def test_late_rows_are_counted(spark):
    first = events(spark, [(1, "a", 1.0), (5, "b", 2.0), (60, "a", 4.0)])  # the watermark is 58 hours in
    second = events(spark, [(2, "a", 8.0), (23, "b", 8.0), (49, "a", 16.0), (61, "b", 32.0)])  # two rows are of days that have passed
    got = {r.event_type: (r.n, r.total, r.n_late) for r in J.merged_totals(*J.drained_in_parts(spark, [first, second], J.speaker_totals, "update")).collect()}
    assert got == {"a": (3, 21.0, 2), "b": (2, 34.0, 2)}


def test_repeated_rows_come_once(spark):
    first = events(spark, [(1, "a", 1.0), (60, "a", 4.0)])
    rows, read = J.drained_in_parts(spark, [first.union(first), first.where("event_id = 1")], J.deduplicated)
    assert sorted(r.event_id for r in rows.collect()) == [0, 1] and read == 5


def test_window_percentiles_keep_their_bound(spark):
    rng = random.Random(7)
    values = [rng.uniform(0, 1) for _ in range(30_000)]
    df = events(spark, [(k % 20, "a", v) for k, v in enumerate(values)]).repartition(8)
    got = J.window_stats(df).first()
    for p, v in ((0.5, got.p50), (0.95, got.p95)):
        assert abs(sum(x <= v for x in values) - p * len(values)) <= len(values) / J.RANKS + 1
