import hashlib
import random
from collections import Counter

import pytest

from spanline.llm.repeats import remove_repeats, repeated_starts


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if counts[d[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    out = [None, "", "short", "=" * 700, "abc" * 300, "abc" * 100]
    for k in range(40):
        t = " ".join(word() for _ in range(rng.randint(5, 200)))
        if k % 3 == 0:
            t += rng.choice(passage) + " ".join(word() for _ in range(30)) + rng.choice(passage)
        if k % 5 == 0:
            t = t + " " + t[: len(t) // 2]
        out.append(t)
    near = out[-1].split(" ")
    for k in range(6):
        own = list(near)
        own[rng.randrange(len(own))] = word()
        out.append(" ".join(own))
    return [*out, out[-1], out[10]]


@pytest.mark.parametrize("group_rows", [2000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, group_rows):
    own = texts(seed)
    ids = [None if k == 3 else k // 2 for k in range(len(own))]  # repeated and null ids
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, own)], "doc_id long, text string, anchor string, n_bytes int").repartition(3)
    got = Counter(tuple(r) for r in remove_repeats(df, group_rows=group_rows).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == Counter((i, *b) for i, b in zip(ids, brute(own, 200)))


def test_suffix_array_finds_runs():
    a, b = b"x" * 5 + b"abcdefghij" + b"q", b"yy" + b"abcdefghij" + b"zz"
    assert repeated_starts([a, b], [1, 1], 4) == [[(0, 1), (5, 11)], [(2, 8)]]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
