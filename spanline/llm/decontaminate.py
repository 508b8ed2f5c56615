"""Benchmark decontamination by Wu-Manber search for many test windows at once.

Patterns are windows of ten words of benchmark items (a shorter item is one window). Over words as letters, a block is
two words: its shift tells how far the search may skip, as no window can end sooner; a shift of 0 selects a bucket of
windows with that last block, and only those are compared word by word. Windows of each length have their own tables.
Words are looked up in the benchmark's own vocabulary, so a comparison of ids is a comparison of words.

The benchmark is dealt by Spark into blocks of at most `block_bytes` (an item that is larger is a block of its own). One block at a time is
broadcast and searched for in all texts, the spans found are kept as a table, and the next block adds to them, so nothing is
dropped and neither the driver nor a task ever holds more than a block.

Defined cases: a null text or item has no words; an item without words never occurs; items alike in words both count;
repeated rows each get a row; empty tables give no rows or no hits; columns of any name are kept as they are.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, cut, dropped, free_name, over_texts

WINDOW = 10
WORDS = ascii_words()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class Search:
    """Wu-Manber tables over the windows of some items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items = [k for k, _ in items]
        self.ids: dict[bytes, int] = {}
        windows: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for n, (_, text) in enumerate(items):
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            for k in range(max(1, len(words) - window + 1) if words else 0):
                own = tuple(words[k : k + window])
                windows[len(own)][own].add(n)
        self.size = len(self.ids) + 1
        self.by_length = [self.tables(length, found) for length, found in sorted(windows.items())]

    def tables(self, length: int, found: dict[tuple, set]) -> dict:
        """Blocks (two words, or the word of one-word windows), their shifts, and the windows in the bucket of each last block."""
        width = min(2, length)
        shift: dict[int, int] = {}
        patterns = sorted(found)
        last = []
        for p in patterns:
            for end in range(width - 1, length):
                block = p[end] if width == 1 else p[end - 1] * self.size + p[end]
                shift[block] = min(shift.get(block, length), length - 1 - end)
            last.append(block)
        order = np.argsort(np.array(last, dtype="i8"), kind="stable")
        blocks = np.array(sorted(shift), dtype="i8")
        return {
            "length": length, "width": width, "blocks": blocks, "shifts": np.array([shift[b] for b in blocks.tolist()], dtype="u1"), "far": length - width + 1,
            "suffixes": np.array(last, dtype="i8")[order], "patterns": np.array(patterns, dtype="i8")[order], "of": [sorted(found[patterns[k]]) for k in order],
        }

    def ends(self, t: dict, ids: np.ndarray) -> np.ndarray:
        """Where a window may end: places whose block has shift 0. Walks with the shifts, as no window ends between."""
        block = ids if t["width"] == 1 else ids[:-1] * self.size + ids[1:]
        if len(block) == 0:
            return np.empty(0, dtype="i8")
        at = np.searchsorted(t["blocks"], block)
        at[at == len(t["blocks"])] = 0
        shifts = np.where(t["blocks"][at] == block, t["shifts"][at], t["far"]).astype("u1").tobytes()
        found, p, n = [], t["length"] - t["width"], len(shifts)
        while p < n:
            s = shifts[p]
            if s:
                p += s
            else:
                found.append(p + t["width"] - 1)
                p += 1
        return np.array(found, dtype="i8")

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The word spans of windows that occur, and the items they belong to."""
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], dtype="i8")
        spans, items = [], set()
        if not len(ids) or not ids.any():
            return spans, items
        for t in self.by_length:
            ends = self.ends(t, ids)
            if not len(ends):
                continue
            block = ids[ends] if t["width"] == 1 else ids[ends - 1] * self.size + ids[ends]
            low, high = np.searchsorted(t["suffixes"], block, "left"), np.searchsorted(t["suffixes"], block, "right")
            count = high - low
            end = np.repeat(ends, count)
            pattern = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            for k in range(t["length"]):  # direct comparison, word by word, of what is left
                same = ids[end - t["length"] + 1 + k] == t["patterns"][pattern, k]
                end, pattern = end[same], pattern[same]
            spans += [(int(e) - t["length"] + 1, int(e) + 1) for e in end]
            for p in np.unique(pattern):
                items.update(t["of"][p])
        return spans, items


def blocks_of(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, list[int]]:
    """item_id, text and block of the items that have a text, and the blocks' numbers; halved by hashes until none is too large."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
        sizes = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("size"), F.count_distinct("item_id", "text").alias("items"))
        if not sizes.where((F.col("size") > block_bytes) & (F.col("items") > 1)).limit(1).count():
            return dealt, sorted(r.block for r in sizes.select("block").collect())
        n *= 2


#: The tables of the block that a worker has searched for last.
_LAST: dict[str, Search] = {}


def find_benchmark(docs: DataFrame, benchmark: DataFrame, out: str = "__hit", block_bytes: int = 8 << 20) -> DataFrame:
    """docs with a struct column `out`: n_words, n_hit, n_items, items (sorted item_ids), items_sha256, contaminated."""
    spark = docs.sparkSession
    found = docs.withColumn(out, F.lit(None).cast("struct<n_words: long, spans: array<int>, items: array<string>>"))
    kind = "n_words long, spans array<int>, items array<string>"
    columns = docs.columns
    more_name = free_name(found, "__more")

    def passed(found: DataFrame, search) -> DataFrame:
        def work():
            name, block = search.value
            if name not in _LAST:
                _LAST.clear()
                _LAST[name] = Search(block)
            tables = _LAST[name]

            def do(texts: list) -> dict:
                got: dict[str, list] = {"n_words": [], "spans": [], "items": []}
                for text in texts:
                    words = words_of(text)
                    spans, items = tables.spans(words)
                    got["n_words"].append(len(words))
                    got["spans"].append([x for s in spans for x in s])
                    got["items"].append(sorted({tables.items[k] for k in items}))
                return got

            return do

        more = over_texts(found, work, kind, more_name)
        before, after = f"`{out}`", f"`{more_name}`"
        both = F.expr(f"named_struct('n_words', {after}.n_words, 'spans', concat(coalesce({before}.spans, array()), {after}.spans), 'items', array_union(coalesce({before}.items, array()), {after}.items))")
        return more.select(*[F.col(f"`{c}`") for c in columns], both.alias(out))

    dealt, numbers = blocks_of(benchmark, block_bytes)
    for k in numbers or [0]:
        block = sorted((r.item_id, r.text) for r in dealt.where(F.col("block") == k).select("item_id", "text").collect())
        search = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        if len(numbers) > 1:
            before, found = found, cut(passed(found, search))
            if k != numbers[0]:
                dropped(before)
            search.unpersist()
        else:
            found = passed(found, search)
    spans = "array_sort(transform(sequence(1, size(s) div 2), i -> struct(s[2 * i - 2] AS a, s[2 * i - 1] AS b)))"
    hit = f"""transform(array(`{out}`.spans), s -> if(size(s) = 0, 0L, aggregate({spans}, struct(0L AS n, 0 AS last),
        (x, y) -> struct(x.n + greatest(0, y.b - greatest(y.a, x.last)) AS n, greatest(x.last, y.b) AS last), x -> x.n)))[0]"""
    items = f"array_sort(`{out}`.items)"
    result = F.expr(f"named_struct('n_words', `{out}`.n_words, 'n_hit', {hit}, 'n_items', bigint(size(`{out}`.items)), 'items', {items}, 'items_sha256', sha2(array_join({items}, ','), 256))")
    done = found.withColumn(out, result)
    return done.withColumn(out, F.col(f"`{out}`").withField("contaminated", F.col(f"`{out}`")["n_hit"] > 0))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every text."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = find_benchmark(slim, benchmark, block_bytes=block_bytes)
    return found.select("doc_id", *[f"__hit.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])
