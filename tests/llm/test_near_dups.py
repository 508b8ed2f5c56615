import random

import pytest

from spanline.llm.near_dups import near_duplicates, one_of_each_group


def brute(rows, words, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, len(s), least[find(k)], i is not None and i == least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def sample(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(rng.randint(60, 150))] for _ in range(5)]
    out = [None, "", "one", "One", "two words", " \n", "a b c d", "A b c d\t"]
    for b in base:  # copies with edits around the threshold, so that some reach the hub only through others
        for _ in range(35):
            own = list(b)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own[: rng.choice([len(own), len(own), len(own) - 12])]))
    for k in range(12):  # a chain: each differs a little from the one before
        own = (out[-1] or "").split()
        own[(k * 9) % len(own)] = word()
        out.append(" ".join(own))
    out += [" ".join(word() for _ in range(50)) for _ in range(20)] + out[30:36]
    rng.shuffle(out)
    return [(None if k % 41 == 0 else k // 2 if k > 200 else k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed,words", [(1, 4), (2, 5)])
def test_equals_brute_force(spark, seed, words):
    rows = sample(seed)
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, n int, fp binary").repartition(3)
    got = near_duplicates(df, words, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, words, 80)


def test_one_of_each_group_keeps_columns(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "x y z u v w"), (None, "q r s t u v"), (None, None), (4, None)]
    df = spark.createDataFrame([(i, t, k, "fp") for k, (i, t) in enumerate(rows)], "doc_id long, text string, root int, fp string")
    got = one_of_each_group(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, "a b c d e f"), (3, "x y z u v w"), (4, None), (None, None), (None, "q r s t u v")], key=repr)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
