"""Assignment, word error rates, point matching, keyword spans, leak scans and cluster measures against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from spanline.operators import clustering as K
from spanline.operators import diarization as D
from spanline.operators import evidence as E
from spanline.operators import sampling as P


def by_subsets(w):
    best = {0: 0}
    for row in w:
        new = dict(best)
        for mask, total in best.items():
            for c, x in enumerate(row):
                if not mask >> c & 1:
                    new[mask | 1 << c] = max(new.get(mask | 1 << c, 0), total + x)
        best = new
    return max(best.values())


def test_assignment_of_many_speakers():
    rng = random.Random(5)
    for n, m in ((13, 13), (12, 14), (14, 9), (1, 6)):
        w = [[rng.choice([0, 0, rng.randint(1, 1000)]) for _ in range(m)] for _ in range(n)]
        pairs = D.best_assignment(w)
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs) and all(w[r][c] > 0 for r, c in pairs)
        turned = w if m <= n else [list(x) for x in zip(*w)]
        assert sum(w[r][c] for r, c in pairs) == by_subsets(turned)
    hidden = rng.sample(range(60), 60)
    w = [[1000 + rng.randint(0, 9) if hidden[r] == c else rng.randint(0, 900) for c in range(60)] for r in range(60)]
    assert D.best_assignment(w) == list(enumerate(hidden))
    assert D.best_assignment([]) == D.best_assignment([[]]) == D.best_assignment([[0, 0]]) == []


def least_match(a, b):
    few, many = sorted((sorted(a), sorted(b)), key=len)
    return min((sum(abs(x - y) for x, y in zip(few, way)) for way in itertools.combinations(many, len(few))), default=0)


def test_points_match_with_least_distance(spark):
    rng = random.Random(6)
    rows = {"ref": [], "hyp": []}
    for rec in range(12):
        for side in rows:
            rows[side] += [(rec, t) for t in rng.sample(range(60), rng.randint(0, 9))]
    frames = [spark.createDataFrame(rows[s], "recording_id long, t long").repartition(3) for s in rows]
    got = [tuple(r) for r in E.match_points(*frames).collect()]
    for rec in range(12):
        a, b = ([t for r, t in rows[s] if r == rec] for s in rows)
        own = [(r, h) for k, r, h in got if k == rec]
        assert len(own) == min(len(a), len(b)) == len({r for r, _ in own}) == len({h for _, h in own})
        assert sum(abs(r - h) for r, h in own) == least_match(a, b)
    for _ in range(200):
        a, b = (np.sort(np.array(rng.sample(range(40), rng.randint(0, 7)), dtype="i8")) for _ in range(2))
        i, j = E.matched_in_order(a, b)
        assert sum(abs(a[i] - b[j])) == least_match(a.tolist(), b.tolist())


def slow_distance(words, spans, others, points, collar):
    t = [[max(i, j) if not i or not j else 0 for j in range(len(others) + 1)] for i in range(len(words) + 1)]
    for i, (w, (s, e)) in enumerate(zip(words, spans), 1):
        for j, (o, p) in enumerate(zip(others, points), 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1)
            if s - collar <= p <= e + collar:
                t[i][j] = min(t[i][j], t[i - 1][j - 1] + (w != o))
    return t[-1][-1]


def test_time_constrained_distance_equals_the_table():
    rng = random.Random(7)
    for _ in range(150):
        n, m = rng.randint(0, 9), rng.randint(0, 9)
        spans = sorted((s, s + rng.randint(0, 5)) for s in (rng.randint(0, 40) for _ in range(n)))
        points = sorted(rng.randint(0, 40) for _ in range(m))
        a, b = [rng.choice("abc") for _ in range(n)], [rng.choice("abc") for _ in range(m)]
        assert E.constrained_distance(a, [s for s, _ in spans], [e for _, e in spans], b, points, 4) == slow_distance(a, spans, b, points, 4)


def test_attributed_rates_differ_as_they_should(spark):
    """Two speakers whose names are swapped in time: words alone map one way, common time the other."""
    kind = "recording_id long, speaker_id string, turn long, start_ms long, end_ms long, words array<string>"
    ref = spark.createDataFrame([(1, "a", 0, 0, 1000, ["x", "y", "z"]), (1, "b", 1, 60_000, 61_000, ["u", "v"]), (2, "a", 0, 0, 100, ["only"])], kind)
    hyp = spark.createDataFrame([(1, "p", 0, 0, 1000, ["u", "v"]), (1, "q", 1, 60_000, 61_000, ["x", "y", "z"])], kind)
    plain = lambda df: df.select("recording_id", "speaker_id", "turn", "words")
    turns = lambda df: df.selectExpr("turn AS event_id", "recording_id", "speaker_id", "start_ms", "end_ms")
    cp = {r.recording_id: (r.n_ref, r.errors) for r in E.concatenated_error_rate(plain(ref), plain(hyp)).collect()}
    sa = {r.recording_id: (r.n_ref, r.errors) for r in E.attributed_error_rate(plain(ref), plain(hyp), turns(ref), turns(hyp)).collect()}
    tcp = {r.recording_id: (r.n_ref, r.errors) for r in E.time_constrained_error_rate(E.timed_words(ref), E.timed_words(hyp)).collect()}
    assert cp == {1: (5, 0), 2: (1, 1)} and sa == {1: (5, 6), 2: (1, 1)} and tcp == {1: (5, 6), 2: (1, 1)}
    times = [(round(x.a), round(x.b)) for x in E.timed_words(ref).where("speaker_id = 'a' AND recording_id = 1").first().words]
    assert times == [(0, 333), (333, 667), (667, 1000)]


def test_keyword_spans_keep_their_places(spark):
    texts = ["", "Nothing here", "Keyword in Keywords, then Longestword! KeywordX Andother", "été Bonjour-Monsieur Abcdefg\nAbcdefgh"]
    got = {}
    for r in E.keyword_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), r"[\p{L}\p{N}]+", "[A-Z][a-z]{5,}", 3).collect():
        got.setdefault(r.doc_id, []).append((r.at, r.n))
    for k, t in enumerate(texts):
        words = [(m.start() + 1, len(m[0])) for m in re.finditer(r"[^\W_]+", t) if re.fullmatch("[A-Z][a-z]{5,}", m[0])]
        assert sorted(got.get(k, [])) == sorted(sorted(words, key=lambda w: (-w[1], w[0]))[:3])


@pytest.mark.parametrize("filter_bits", [1 << 27, 64])
def test_leak_scan_equals_brute_force(spark, filter_bits):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdeé -,") for _ in range(n))
    private = [(k, text(rng.randint(5, 60))) for k in range(12)]
    public = [(100 + k, text(20) + (private[k % 12][1][: rng.randint(0, 60)] if k % 2 else "") + text(30)) for k in range(40)] + [(200, None), (201, ""), (101, "x")]
    clean = lambda t: re.sub(r"[\W_]+", "", (t or "").lower())
    want = {}
    for i, p in private:
        t = clean(p)
        parts = {t[k : k + 16] for k in range(0, len(t) - 15, 8)}
        for j, q in public:
            found = {f for f in parts if f in clean(q)}
            if found:
                want.setdefault((j, i), set()).update(found)
    frames = [spark.createDataFrame(x, "id long, text string").repartition(3) for x in (private, public)]
    got = {(r.public_id, r.private_id): r.n_fragments for r in P.leak_scan(*frames, filter_bits=filter_bits).collect()}
    assert got == {k: len(v) for k, v in want.items()} and got
    short = spark.createDataFrame([(1, "Pin 42!"), (2, "other"), (3, "--")], "id long, text string")
    seen = spark.createDataFrame([(7, "pin-42"), (8, "Pin 42!"), (9, "!!"), (10, None)], "id long, text string")
    assert sorted(tuple(r) for r in P.whole_leaks(short, seen).collect()) == [(7, 1, "normalized"), (8, 1, "exact")]


def test_cluster_measures_equal_numpy(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=8) * 3 + rng.normal(size=(n, 8)) for n in (40, 30, 2)])
    points = K.unit_vectors(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>"))
    own, centres = K.spherical_kmeans(points, 3)
    got = K.cluster_quality(own, centres).first()
    rows = own.orderBy("vec_id").collect()
    x, c = np.array([r.v for r in rows]), np.array([r.cluster for r in rows])
    means = {k: x[c == k].mean(axis=0) for k in set(c.tolist())}
    within = sum(((x[c == k] - m) ** 2).sum() for k, m in means.items())
    between = sum((c == k).sum() * ((m - x.mean(axis=0)) ** 2).sum() for k, m in means.items())
    spread = {k: np.linalg.norm(x[c == k] - m, axis=1).mean() for k, m in means.items()}
    gap = lambda a, b: np.linalg.norm(means[a] - means[b])
    n, k = len(x), len(means)
    assert abs(got.calinski_harabasz - between / (k - 1) / (within / (n - k))) < 1e-3
    assert abs(got.davies_bouldin - np.mean([max((spread[a] + spread[b]) / gap(a, b) for b in means if b != a) for a in means])) < 1e-5
    assert abs(got.separation - min(gap(a, b) for a in means for b in means if a != b)) < 1e-5 and got.n_clusters == k
    assert abs(got.compactness - np.mean([r.similarity for r in rows])) < 1e-5


def test_merging_goes_on_until_nothing_merges(spark):
    pairs = [("k", a, a + 1, 0.9 - 0.01 * (a % 2)) for a in range(40)] + [("l", 1, 2, 0.1)]
    got = {(r.key, r.member): r.label for r in K.merge_runs(spark.createDataFrame(pairs, "key string, a long, b long, score double"), 0.5).collect()}
    assert {got["k", m] for m in range(41)} == {0} and (got["l", 1], got["l", 2]) == (1, 2)


def test_colour_difference_gives_published_values(spark):
    """Pairs and differences that the formula's authors published for checking implementations."""
    from pyspark.sql import functions as F

    from spanline.functions.colour import ciede2000, lab

    pairs = [
        ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((50, 0, 0), (50, -1, 2), 2.3669), ((50, 2.49, -0.001), (50, -2.49, 0.0009), 7.1792),
        ((50, 2.5, 0), (50, 0, -2.5), 4.3065), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
    ]
    side = "struct<l: double, a: double, b: double>"
    df = spark.createDataFrame([(tuple(map(float, x)), tuple(map(float, y)), d) for x, y, d in pairs], f"x {side}, y {side}, d double")
    got = df.select("d", ciede2000(F.col("x"), F.col("y")).alias("e"), ciede2000(F.col("y"), F.col("x")).alias("f")).collect()
    assert all(abs(r.d - r.e) < 6e-5 and abs(r.e - r.f) < 1e-9 for r in got)
    white = spark.range(1).select(lab(F.lit(255), F.lit(255), F.lit(255)).alias("x")).first().x
    assert abs(white.l - 100) < 1e-3 and abs(white.a) < 0.02 and abs(white.b) < 0.02


def test_strict_json(spark):
    from spanline.sources.formats import is_strict_json, transcripts

    bad = ["", None, "{", '{"a":1,"a":2}', '{"a":{"b":1,"b":1}}', '{"a":NaN}', "[Infinity]", "[1e999]", '{"a":1} x']
    assert not any(map(is_strict_json, bad)) and all(map(is_strict_json, ['{"a":1,"b":{"a":2}}', "[1.5, null, true]", '"text"']))
    rows = [('{"documentId":"d","segments":[{"id":"s","start_ms":0,"end_ms":5,"text":"t"}]}',), ('{"documentId":"d","documentId":"e","segments":[]}',), ('{"segments":[]}',), (None,)]
    good, rest = transcripts(spark.createDataFrame(rows, "value string"))
    assert [(r.documentId, r.id) for r in good.collect()] == [("d", "s")] and rest.count() == 3


def test_activity_runs_keep_open_ones(spark):
    from spanline.streaming import jobs as J

    rows = [(k, f"2024-01-01 00:{k:02d}:00", k % 2, float(v)) for k, v in enumerate([1, 9, 9, 9, 1, 1, 9, 9, 9, 1, 9, 9])]
    path = f"{J.shared_folder(spark)}/frames"
    for part in (rows[:5], rows[5:]):  # two files, two batches
        spark.createDataFrame(part, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "cast(ts AS timestamp) AS ts", "user_id", "value").coalesce(1).write.mode("append").parquet(path)
    out = J.drained(J.activity_runs(J.event_stream(spark, path), 5.0), "update")
    last = {}
    for r in sorted(out.collect(), key=lambda r: r["__batch"]):
        last[r.user_id, r.first_id] = (r.n, r.open)
    assert last == {(0, 2): (1, False), (0, 6): (3, True), (1, 1): (2, False), (1, 7): (1, False), (1, 11): (1, True)}
