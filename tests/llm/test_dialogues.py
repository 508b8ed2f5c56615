"""Conversation repair and the prefix trie against brute force, with nulls, ties, repeats, empty tables and clashing columns; the slot table on its own."""

import hashlib
import heapq
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanline.llm import dialogue_repair, prefix_trie, queries
from tests.oracle import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def faulty(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """All edit sequences in order of (cost, letters); the first complete one."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, counts, items = set(), Counter(), []
    for _, _, r, x in rows:
        s = x.rstrip(" \t\n\v\f\r")
        fault = "blank" if not s else "duplicate" if (r, x) in seen else "" if s[-1] in ".!?" else "truncated"
        counts[fault] += 1
        seen.add((r, x))
        items.append((r, x, fault))
    initials = [r[:1] for r, _, _ in items]
    known = [t for _, t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(items) and state in ("", "a"):
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        steps = [(2, "I", i, role, "") for role in ("user", "assistant")]
        if i < len(items):
            role, text, fault = items[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, kept))
            if fault not in ("blank", "duplicate"):
                steps += [(fault == "truncated", "K", i + 1, role, text)] + [(2 + (fault == "truncated"), "R", i + 1, r, text) for r in ("user", "assistant")]
        for price, letter, place, role, text in steps:
            if role[:1] and role[0] in NEXT[state]:
                heapq.heappush(heap, (cost + price, audit + letter, place, role[0], (*kept, (role, text))))


def repaired(rows):
    by = {c: [] for c, _, _, _ in rows}
    for r in faulty(rows):
        by[r[0]].append(r)
    return {c: cheapest(x) if x else EMPTY for c, x in by.items()}


def odd_rows():
    rng = random.Random(3)
    one = [(rng.choice([None, 1, 2, 3, 4, 5, 6, -7]), rng.choice([None, *range(40)]), rng.choice([None, "", "user", "assistant", "system", "tool", "s", "u"]), rng.choice([None, "", " \n", "ok.", "hm", "why? \n", "  a! ", "x y"])) for _ in range(400)]
    long = [(9, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["yes.", "no", "é" * 300 + "!", ""]) + str(k % 90) * (k % 3) + ".") for k in range(700)]
    return [*one, *long, (8, 3, "user", "z" * 2_000_000 + "."), *[(11, 1, "assistant", "again.")] * 50]


@pytest.mark.parametrize("least_block", [1, 3, 64])
def test_repair_equals_all_edit_sequences(spark, least_block):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, `a.b` string, cost int").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in dialogue_repair.audited(dialogue_repair.damaged(df), df, least_block).collect()}
    assert got == repaired(rows)
    assert dialogue_repair.audited(dialogue_repair.damaged(df.limit(0)), df.limit(0)).count() == 0
    edits = dialogue_repair.repaired(df, least_block).orderBy("conv_id", "no").collect()
    by = {}
    for e in edits:
        by.setdefault(e.conv_id, []).append(e)
    for conv, steps in by.items():
        assert [e.no for e in steps] == list(range(len(steps)))
        assert re.fullmatch("(s?(ua)+)?", "".join(e.role[:1] for e in steps if e.edit != "D")), conv


def test_query_of_repair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries.op12_dialogue_repair(spark, SF).collect()} == repaired(rows)


def nodes(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    by = {c: [y[2:] for y in sorted(v)] for c, v in by.items()}
    built = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = by.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not children[k]
        saved[k] += (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    ends = {k: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))) for k, m in members.items()}
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items())


FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("limits", [(), (5, 7), (0, 1)])
def test_trie_equals_brute_force(spark, limits):
    rng = random.Random(3)
    rows = [(rng.choice([None, -3, *range(95, 130), *range(200, 230)]), rng.choice([None, *range(6)]), rng.choice([None, "", "user"]), rng.choice([None, "", "é", "ok"])) for _ in range(500)]
    rows += [(c, k, "user", "same") for c in range(300, 340) for k in range(4)] + [(400, k, "user", "deep") for k in range(300)] + [(405, 0, "user", "w" * 1_000_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, digest string").repartition(3)
    got = prefix_trie.family_trie(df, *limits)
    assert Counter(tuple(r) for r in got.select(*FIELDS).collect()) == nodes(rows)
    assert prefix_trie.family_trie(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_of_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.op13_prefix_trie(spark, SF).select(*FIELDS).collect()) == nodes(rows)
    assert compare(spark, SF, queries.op13_prefix_trie, queries.SQL["op13_prefix_trie"]) is None


def test_slots_are_minimal_perfect_and_checked():
    words = [hashlib.sha256(b"%d" % k).digest() for k in range(5000)]
    keys = np.frombuffer(b"".join(words), dtype="<u8").reshape(-1, 4)
    table = prefix_trie.SlotTable(keys[:4000])
    assert sorted(table.find(keys[:4000]).tolist()) == list(range(4000))
    assert (table.keys[table.find(keys[:4000])] == keys[:4000]).all() and (table.find(keys[4000:]) == -1).all()
    near = keys[:50].copy()
    near[:, 3] ^= np.uint64(1)
    assert (table.find(near) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(keys[[0, 1, 1]])
    assert len(prefix_trie.SlotTable(keys[:0]).find(keys[:3])) == 3
