"""Repeated strings: enhanced suffix arrays with a common-prefix interval tree, over anchored stretches of all texts.

A byte is removed if it lies in a string of LENGTH bytes that also starts anywhere else. Every string of LENGTH bytes has
an anchor, the least hash among its GRAM-byte grams, which depends on the string alone; so equal strings have equal
anchors at equal offsets, and only stretches with one anchor need to be compared. A stretch is the run of string starts
that share an anchor occurrence. An anchor that occurs once is done; if all its stretches are equal, all of them repeat;
else one copy of each different stretch is cut to the strings whose hash comes twice, and each different piece goes into a suffix
array (many anchors at once, in runs of bounded size), whose common-prefix interval tree is scanned with a stack: an interval whose members differ in the byte to their left is a
maximal repeat, and all its occurrences are marked. Anchors with more than `group_rows` occurrences never meet in one task:
their strings are counted by hash of anchor, offset and content, with map-side sums. That path is exact in the same way.

Defined cases: a null text has no bytes; a text shorter than LENGTH repeats nothing; repeated rows are copies of each
other; overlapping places of one text count as places; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small

LENGTH, GRAM = 200, 48
GROUP_ROWS = 20_000
BROADCAST_ROWS = 200_000
RUN_BYTES = 2 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LETTERS = (np.arange(1, 257, dtype="u8") * _A) ^ (np.arange(1, 257, dtype="u8") * _B >> np.uint64(17))


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _A
    out ^= out >> np.uint64(31)
    out += right
    out *= _B
    out ^= out >> np.uint64(29)
    return out


def block_hashes(data: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all strings of each width (powers of two), by doubling."""
    level, width, found = _LETTERS[data], 1, {}
    while True:
        if width in widths:
            found[width] = level
        if width == max(widths):
            return found
        level = mixed(level[:-width], level[width:]) if len(level) > width else np.empty(0, dtype="u8")
        width *= 2


def window_least(keys: np.ndarray, size: int) -> np.ndarray:
    """The least key of each run of `size` keys."""
    n = len(keys) - size + 1
    padded = np.full(-(-len(keys) // size) * size, np.iinfo("u8").max, dtype="u8")
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, size)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[size - 1 : size - 1 + n])


def stretches(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For texts that lie one behind the other in `data` (at `starts`, closed by the end of data): text number, anchor hash, span hash, first string start in its text, width (string starts less one)."""
    none = tuple(np.empty(0, dtype="i8") for _ in range(5))
    if len(data) < length:
        return none
    low = gram - (1 << (gram.bit_length() - 1))
    widths = [1 << (gram.bit_length() - 1), *([low] if low else []), 128]
    level = block_hashes(data, widths)
    big = widths[0]
    grams = mixed(level[big][: len(data) - gram + 1], level[low][big : len(data) - gram + 1 + big]) if low else level[big]
    place = np.uint64((1 << max(1, len(data).bit_length())) - 1)
    least = window_least((grams & ~place) | np.arange(len(grams), dtype="u8"), length - gram + 1)
    anchor = (least & place).astype("i8")
    text = np.searchsorted(starts, np.arange(len(anchor)), "right") - 1
    ends = np.append(starts[1:], len(data))
    fits = np.arange(len(anchor)) + length <= ends[text]
    if not fits.any():
        return none
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~fits[:-1]
    first = np.flatnonzero(new & fits)
    stops = np.flatnonzero(fits & np.append(new[1:] | ~fits[1:], True))
    blocks = level[128]
    end = stops + length
    span = mixed(mixed(blocks[first], blocks[(first + end) // 2 - 64]), mixed(blocks[end - 128], (end - first).astype("u8") * _A + (anchor[first] - first).astype("u8")))
    return text[first], grams[anchor[first]].view("i8"), span.view("i8"), first - starts[text[first]], stops - first


def stretch_rows(base: DataFrame, length: int, gram: int) -> DataFrame:
    """(d, th, anchor, span, n, width, starts): the different stretches of each text and where they start."""
    columns = "d long, th long, anchor long, span long, n int, width int, starts array<int>"

    def run(batches):
        for batch in batches:
            done = 0
            for part in slices(batch.column("text")):
                texts = [x.encode() for x in part.to_pylist()]
                data = np.frombuffer(b"".join(texts), dtype="u1")
                starts = np.cumsum([0, *map(len, texts)])[:-1]
                text, anchor, span, first, width = stretches(data, starts, length, gram)
                order = np.lexsort((first, span, anchor, text))
                text, anchor, span, first, width = text[order], anchor[order], span[order], first[order], width[order]
                if len(text):
                    new = np.ones(len(text), dtype=bool)
                    new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])
                    head = np.flatnonzero(new)
                    offsets = np.append(head, len(text)).astype("i4")
                    rows = pa.array(text[head] + done)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("d").take(rows), batch.column("th").take(rows), pa.array(anchor[head]), pa.array(span[head]), pa.array(np.diff(offsets)), pa.array(width[head].astype("i4")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(first.astype("i4")))],
                        names=["d", "th", "anchor", "span", "n", "width", "starts"],
                    )
                done += len(part)

    return base.mapInArrow(run, columns)


class SuffixArray:
    """Sorted suffixes of some strings, each closed by a letter below all others, with common prefixes inside the strings, by prefix doubling from 7 letters on."""

    FIRST = 7

    def __init__(self, strings: list[bytes], depth: int):
        sizes = np.array([len(s) for s in strings])
        self.starts = np.cumsum([0, *(sizes[:-1] + 1)])
        n = int(sizes.sum()) + len(strings)
        self.letters = np.zeros(n + self.FIRST, dtype="i8")
        inside = np.ones(n, dtype=bool)
        inside[self.starts + sizes] = False
        self.letters[:n][inside] = np.frombuffer(b"".join(strings), dtype="u1").astype("i8") + 1
        self.left = np.repeat(self.starts + sizes, sizes + 1) - np.arange(n)  # letters of its string from each place on
        key = np.zeros(n, dtype="i8")
        for k in range(self.FIRST):
            key = key << 9 | self.letters[k : k + n]
        rank, width = self.ranked(key), self.FIRST
        self.levels = {width: rank}
        while width < depth:
            after = np.zeros(n, dtype="i8")
            after[: max(0, n - width)] = rank[width:]
            rank = self.ranked(rank * (n + 2) + after)
            width *= 2
            self.levels[width] = rank
        self.order = np.argsort(rank, kind="stable")
        self.common = self.prefixes(self.order[:-1], self.order[1:])

    @staticmethod
    def ranked(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        held = keys[order]
        out = np.empty(len(keys), dtype="i8")
        out[order] = np.cumsum(np.concatenate(([1], held[1:] != held[:-1])))
        return out

    def prefixes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, done = len(self.left), np.zeros(len(a), dtype="i8")
        for width in sorted(self.levels, reverse=True):
            level = self.levels[width]
            i, j = a + done, b + done
            done += ((i < n) & (j < n) & (level[np.minimum(i, n - 1)] == level[np.minimum(j, n - 1)])) * width
        for _ in range(self.FIRST - 1):
            i, j = np.minimum(a + done, n), np.minimum(b + done, n)
            done += (self.letters[i] == self.letters[j]) & (i < n) & (j < n)
        return np.minimum(done, np.minimum(self.left[a], self.left[b]))

    def maximal_repeats(self, least: int):
        """(common prefix, members) of every interval of at least `least` letters whose members differ to the left. A stack scan over the common prefixes."""
        common = self.common
        stack: list[list] = []
        good = np.flatnonzero(common >= least)
        for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else []:
            values = [*common[run].tolist(), 0]
            base = int(run[0])
            for k, value in enumerate(values):
                left = base + k
                while stack and stack[-1][0] > value:
                    depth, left = stack.pop()
                    members = self.order[left : base + k + 1]
                    if self.diverse(members):
                        yield depth, members
                if value and (not stack or stack[-1][0] < value):
                    stack.append([value, left])
            stack.clear()

    def diverse(self, members: np.ndarray) -> bool:
        before = self.letters[members - 1]
        return bool((members == 0).any() or (before == 0).any() or (before != before[0]).any())


def runs_of(marked: np.ndarray) -> list[tuple[int, int]]:
    own = np.flatnonzero(np.diff(np.concatenate(([0], marked.view("i1"), [0]))))
    return [(int(a), int(b) - 1) for a, b in own.reshape(-1, 2)]


def repeated_starts(strings: list[bytes], copies: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each string the runs (first, last) of its starts of `length` bytes that also stand elsewhere; strings with copies repeat throughout."""
    if not strings:
        return []
    suffixes = SuffixArray(strings, max(map(len, strings)))
    marks = np.zeros(len(suffixes.left) + 1, dtype="i4")
    for common, members in suffixes.maximal_repeats(length):
        np.add.at(marks, members, 1)
        np.add.at(marks, members + common - length + 1, -1)
    marked = np.cumsum(marks) > 0
    return [[(0, len(text) - length)] if n > 1 else runs_of(marked[s : s + len(text) - length + 1]) for s, text, n in zip(suffixes.starts.tolist(), strings, copies, strict=True)]


def likely_runs(strings: list[bytes], copies: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Runs of starts whose strings of `length` bytes may stand elsewhere, as their hash does: nothing that repeats is left out."""
    data = np.frombuffer(b"".join(strings), dtype="u1")
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes) - sizes
    half = 1 << (length.bit_length() - 1)
    level = block_hashes(data, [half])[half]
    hashes = mixed(level[: len(data) - length + 1], level[length - half : length - half + len(data) - length + 1])
    per = sizes - length + 1  # every stretch holds a string at least
    at = np.arange(per.sum()) + np.repeat(starts - (np.cumsum(per) - per), per)
    _, inverse, n = np.unique(hashes[at], return_inverse=True, return_counts=True)
    again = (n[inverse] > 1) | np.repeat(np.array(copies) > 1, per)
    return [runs_of(own) for own in np.split(again, np.cumsum(per)[:-1])]


def solved_run(strings: list[bytes], copies: list[int], length: int) -> list[list[tuple[int, int]]]:
    """repeated_starts of stretches by way of their likely pieces, each different piece once."""
    likely = likely_runs(strings, copies, length)
    pieces: dict[bytes, int] = {}
    for text, n, runs in zip(strings, copies, likely, strict=True):
        for a, b in runs:
            piece = text[a : b + length]
            pieces[piece] = pieces.get(piece, 0) + n
    found = dict(zip(pieces, repeated_starts(list(pieces), list(pieces.values()), length), strict=True))
    return [[(a + x, a + y) for a, b in runs for x, y in found[text[a : b + length]]] for text, runs in zip(strings, likely, strict=True)]


RANGES = "anchor long, span long, ranges array<int>"


def by_suffix_arrays(spans: DataFrame, length: int) -> DataFrame:
    """The repeating starts of different stretches, one anchor always inside one run."""

    def solved(rows: list) -> pa.RecordBatch:
        ranges = solved_run([r[3] for r in rows], [r[2] for r in rows], length)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[x for ab in own for x in ab] for own in ranges], pa.list_(pa.int32()))], names=["anchor", "span", "ranges"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("anchor", "span", "copies", "bytes")], strict=True):
                if size >= RUN_BYTES and rows[-1][0] != r[0]:
                    yield solved(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        if rows:
            yield solved(rows)

    return spans.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "span", "copies", "bytes").mapInArrow(run, RANGES)


def by_counts(spans: DataFrame, length: int) -> DataFrame:
    """The same for anchors with many occurrences: a row for each string of a different stretch, summed by its content."""

    def run(batches):
        for batch in batches:
            for anchor, span, copies, text in zip(*[batch.column(c).to_pylist() for c in ("anchor", "span", "copies", "bytes")], strict=True):
                n = len(text) - length + 1
                strings = [hashlib.blake2b(text[k : k + length], digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * n, pa.int64()), pa.array([span] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([copies] * n, pa.int64()), pa.array(strings, pa.binary())], names=["anchor", "span", "at", "copies", "string"])

    strings = cut(spans.select("anchor", "span", "copies", "bytes").mapInArrow(run, "anchor long, span long, at int, copies long, string binary"))
    twice = cut(strings.groupBy("string").agg(F.sum("copies").alias("n")).where("n > 1").select("string"))
    return strings.join(twice, "string").groupBy("anchor", "span").agg(F.expr("array_sort(collect_list(at))").alias("at")).select("anchor", "span", F.expr("flatten(transform(at, x -> array(x, x)))").alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = stretch_rows(base.where(F.octet_length("text") >= length), length, gram)
    anchors = cut(rows.groupBy("anchor").agg(F.sum("n").alias("total"), F.min("span").alias("low"), F.max("span").alias("high")).where("total > 1"))
    flagged = cut(rows.join(anchors, "anchor").select("d", "th", "anchor", "span", "n", "width", "starts", "total", (F.col("low") == F.col("high")).alias("whole")))
    keys = cut(flagged.select("d", "th").distinct())
    work = cut(base.join(F.broadcast(keys) if small(keys, BROADCAST_ROWS) else keys, ["d", "th"], "left_semi"))

    open_spans = flagged.where("NOT whole").groupBy("anchor", "span").agg(F.sum("n").alias("copies"), F.min(F.struct("d", "th", F.col("starts")[0].alias("start"), "width")).alias("at"), F.max("total").alias("total"))
    wanted = cut(open_spans.select("at.d", "at.th", F.struct("anchor", "span", "copies", "total", "at.start", "at.width").alias("one")).groupBy("d", "th").agg(F.collect_list("one").alias("wanted")))

    def cut_out(batches):
        for batch in batches:
            got = []
            for own, found in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                own = own.encode()
                got += [(x["anchor"], x["span"], x["copies"], x["total"], own[x["start"] : x["start"] + x["width"] + length]) for x in found]
            if got:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*got, strict=True), kinds, strict=True)], names=["anchor", "span", "copies", "total", "bytes"])

    spans = work.join(wanted, ["d", "th"]).dropDuplicates(["d", "th"]).select("text", "wanted").mapInArrow(cut_out, "anchor long, span long, copies long, total long, bytes binary")
    spans = cut(spans)
    ranges = cut(by_suffix_arrays(spans.where(F.col("total") <= group_rows), length).unionByName(by_counts(spans.where(F.col("total") > group_rows), length)))

    whole = flagged.where("whole").select("d", "th", F.expr("flatten(transform(starts, s -> array(s, s + width)))").alias("runs"))
    partly = flagged.where("NOT whole").join(ranges, ["anchor", "span"]).select("d", "th", F.expr("flatten(transform(starts, s -> transform(ranges, r -> s + r)))").alias("runs"))
    runs = whole.unionByName(partly).where("size(runs) > 0").groupBy("d", "th").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    def take_out(batches):
        for batch in batches:
            got = []
            for own, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data = np.frombuffer(own.encode(), dtype="u1")
                pairs = np.array(found, dtype="i8").reshape(-1, 2)
                marks = np.zeros(len(data) + 1, dtype="i8")
                np.add.at(marks, pairs[:, 0], 1)
                np.add.at(marks, pairs[:, 1] + length, -1)
                gone = np.cumsum(marks)[:-1] > 0
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                got.append((int(gone.sum()), n_spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            if got:
                removed, n_spans, digest = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest)], names=["d", "th", "n_removed", "n_spans", "kept_sha256"])

    taken = work.join(cut(runs), ["d", "th"]).select("d", "th", "text", "runs").mapInArrow(take_out, "d long, th long, n_removed long, n_spans long, kept_sha256 string")
    taken = cut(taken.dropDuplicates(["d", "th"]).withColumnRenamed("kept_sha256", "cut_sha256"))
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own_sha256"))
    out = clean.join(F.broadcast(taken) if small(taken, BROADCAST_ROWS) else taken, ["d", "th"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("cut_sha256", "own_sha256").alias("kept_sha256"))
