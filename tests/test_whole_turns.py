"""Queries over all turns, ids and window starts against brute force."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from spanline.plans import tables
from spanline.plans.catalog import QUERIES

LENGTH, DAY = 1_800_000, 86_400_000


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    rng, out = random.Random(8), str(tmp_path_factory.mktemp("turns"))
    rows = [(k, datetime(2024, 1, 1 + k % 2) + timedelta(milliseconds=rng.randrange(DAY)), rng.choice(tables.SPEAKERS), rng.uniform(1, 250)) for k in range(150)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{out}/events.parquet")
    spark.createDataFrame([(k * 37, f"text {k}", "en", "s", 6) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return out


def windows(spark, where, fifths):
    """(recording, start): milliseconds of each speaker."""
    own, out = [tuple(r) for r in tables.turns_ref(spark, where).collect()], defaultdict(dict)
    for event, rec, _, s, _ in own:
        if s + LENGTH <= DAY and (not fifths or event % 5 == 0):
            spoken = defaultdict(int)
            for _, r, who, a, b in own:
                if r == rec and a < s + LENGTH and s < b:
                    spoken[who] += min(b, s + LENGTH) - max(a, s)
            out[rec, s] = spoken
    return out


def best(found):
    pairs = defaultdict(list)
    for (rec, s), spoken in found.items():
        if len(spoken) == 2:
            pairs[rec].append((min(spoken.values()), sum(spoken.values()), -s))
    return {rec: (-max(x)[2], max(x)[0]) for rec, x in pairs.items()}


def triples(found):
    starts = defaultdict(set)
    for (rec, s), spoken in found.items():
        if sum(ms >= 60_000 for ms in spoken.values()) == 3:
            starts[rec].add(s)
    return {rec: (len(x), min(x)) for rec, x in starts.items()}


def test_windows_start_at_every_turn(spark, where):
    some, every = windows(spark, where, True), windows(spark, where, False)
    assert {r.recording_id: (r.start_ms, r.least_ms) for r in QUERIES["f10_exact_speaker_window"](spark, where).collect()} == best(every) != best(some)
    assert {r.recording_id: (r.n_windows, r.first_ms) for r in QUERIES["f11_windows_with_n_speakers"](spark, where).collect()} == triples(every) != triples(some)


def test_counts_over_every_turn(spark, where):
    count = lambda df: {k: len({r.speaker_id for r in df if r.recording_id == k}) for k in {r.recording_id for r in df}}
    a, b = count(tables.turns_ref(spark, where).collect()), count(tables.turns_hyp(spark, where).collect())
    gaps = [abs(a.get(k, 0) - b.get(k, 0)) for k in a.keys() | b.keys()]
    got = QUERIES["d8_count_accuracy"](spark, where).first()
    assert (got.n_recordings, got.accuracy, got.mean_abs_error) == (len(gaps), round(gaps.count(0) / len(gaps), 9), round(sum(gaps) / len(gaps), 9))


def test_every_id_is_read(spark, where):
    got = QUERIES["a7_row_access"](spark, where).collect()
    assert sorted(r.doc_id for r in got) == [k * 37 for k in range(20)] and all(r.intact for r in got)
