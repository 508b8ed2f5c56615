"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens as begin, inside or outside.

Fixed patterns give the base spans. The chain reads every word and mark of every text, whatever stands there: each has features of
its shape, of the run of characters of values it is part of, of the words around it and of the whole text. Viterbi gives the best tags
of the whole text; a begin token with the inside ones after it is a span. Scores that follow from a word alone are kept by word, the
rest are array steps over many texts at once. Best tags come by blocks of tokens: a (max, +) matrix a block, a walk over the matrices,
the blocks' tags on the way back. Weights are whole multiples of a small number, so sums are exact and tags do not depend on blocks.

The chain is fitted on windows of the documents themselves, at most EXAMPLES with base spans, as many without around what may be a
value, and as many from elsewhere, those least by a hash of their content. Runs that might be secrets but stand in no base span are
left out of the fit. So that it does not just learn the patterns, each example with a secret comes again with the patterns' own words
replaced by other words of the corpus, with its value drawn anew from wider alphabets, without its marks, and with something like an
identifier in place of the value, which is outside.

Defined cases: a null text counts as empty (no spans); a span of the chain may lie inside a base span or cover it, both are
given; a chain span of fewer than LEAST characters is left out; repeated rows each get a row; without any example the chain
adds nothing; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, free_name, over_texts, small_batches, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)

LEAST, AROUND = 8, 80
WITH_DIGIT = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z+/_.=-]*+[0-9][A-Za-z0-9+/_.=-]*")
AFTER_MARK = re.compile(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""")
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
TOKEN = re.compile(r"[^\W_]+|[^\s\w]|_")
WINDOW = re.compile(r"\S.{0,150}\S*", re.DOTALL)
#: Examples of each kind to fit on at most, tokens of each, passes over them, and hashed features.
EXAMPLES, MOST_TOKENS, PASSES, BUCKETS = 500, 64, 40, 1 << 14
OUT, BEGIN, INSIDE = 0, 1, 2
#: Weights are multiples of 1 / FINE; tokens of a block, characters read at once, and words whose scores are kept at most.
FINE, BLOCK, PIECE, WORDS = 1 << 24, 32, 1 << 18, 1 << 17
NEVER = -1e6


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of whole matches, each kind leftmost and without overlaps."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if len(text) >= 32:
        found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def value_ranges(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """What base spans name as secrets: of an assignment the value alone."""
    return [ASSIGN.match(text, start).span(2) if kind == "assign" else (start, end) for start, kind, end in base]


def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges of a text around everything that may be a value: a run of LEAST characters with a letter and a digit, or one after a mark. For examples only; the chain reads all."""
    runs = [m.span() for m in WITH_DIGIT.finditer(text) if m.end() - m.start() >= LEAST and any(c.isalpha() for c in m[0])]
    if ":" in text or "=" in text:
        runs = sorted(runs + [m.span(1) for m in AFTER_MARK.finditer(text)])
    out: list[tuple[int, int]] = []
    for start, end in runs:
        start, end = max(0, start - AROUND), min(len(text), end + AROUND // 2)
        while start and text[start - 1].isalnum() and text[start].isalnum():
            start += 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def shape(token: str) -> str:
    kinds = re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[A-Z]+", "A", token)))
    return kinds if len(kinds) <= 4 else f"{min(len(kinds) // 4, 6)}+"


def entropy(token: str) -> int:
    """In half bits."""
    return int(round(2 * (math.log2(len(token)) - sum(n * math.log2(n) for n in Counter(token).values()) / len(token)), 6))


@functools.lru_cache(1 << 16)
def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def file_features(text: str) -> list[str]:
    return [f"lines:{min(6, int(math.log2(1 + text.count(chr(10)))))}", f"size:{min(9, int(math.log10(1 + len(text)) * 2))}"]


#: How far off the words are whose features a token has.
FAR = (-1, -2, -3, 1, 2)
#: Marks of a word's own features (shape, size, digits, word), then of those that it gives to the tokens around it, by FAR.
SLOTS = np.array([zlib.crc32(x) for x in (b"shape", b"size", b"digits", b"word", b"before1", b"before2", b"before3", b"after1", b"after2")], dtype="u4")
LOWER = zlib.crc32(b"a")


def word_codes(word: str) -> tuple[int, int, int, int]:
    """CRC of its shape, size, share of digits, and CRC of itself; of its shape where it is long or has digits."""
    if word.isalpha() and len(word) <= 12 and word.islower():
        return LOWER, len(word) // 4, 0, zlib.crc32(word.lower().encode())
    kinds = "Aa" if word.isalpha() and "A" <= word[0] <= "Z" and word[1:].islower() else shape(word)
    digits = sum(c.isdigit() for c in word)
    plain = word.lower() if len(word) <= 12 and not digits else kinds
    return zlib.crc32(kinds.encode()), min(len(word), 40) // 4, 5 * digits // max(1, len(word)), zlib.crc32(plain.encode("utf-8", "surrogatepass"))


def word_features(words: list[str]) -> np.ndarray:
    """Hashed features [word, slot]."""
    codes = np.array([word_codes(w) for w in words], dtype="u4").reshape(-1, 4)[:, [0, 1, 2, 3, 3, 3, 3, 3, 3]]
    return ((codes ^ SLOTS) * np.uint32(2654435761) >> np.uint32(18)).astype("i4")  # 14 bits: BUCKETS


RUN_KINDS = {"run": 9, "mixed": 2, "entropy": 14, "switches": 10, "marks": 5, "longest": 6}


def run_kinds(run: str) -> list[str]:
    """Features of a run of characters of values."""
    if len(run) < LEAST:
        return ["short"]
    letters, digits = sum(c.isalpha() for c in run), sum(c.isdigit() for c in run)
    switches = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(run, run[1:]))
    longest = max(map(len, re.split("[^A-Za-z]+", run)))
    found = (min(len(run), 64) // 8, int(bool(letters and digits)), entropy(run), min(9, 20 * switches // len(run)), min(4, len(run) - letters - digits), min(5, longest // 3))
    return [f"{kind}:{x}" for kind, x in zip(RUN_KINDS, found)]


def featured(text: str, about: list[str]) -> list[tuple[int, int, list[int]]]:
    """(start, end, hashed features) of every token of an example; about: features of its whole text."""
    found = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    words = word_features(["", "", "", *(w for _, _, w in found), "", ""]).tolist()
    run_of: dict[int, list[str]] = {}
    for m in VALUE.finditer(text):
        run_of |= dict.fromkeys(range(m.start(), m.end()), run_kinds(m[0]))
    out = []
    for k, (start, end, _) in enumerate(found):
        run = run_of.get(start, ["none"])
        first = not k or found[k - 1][1] < start or run_of.get(found[k - 1][0]) is not run
        features = [hashed(x) for x in ("bias", f"first:{first}", *run, *[f"{x} {first}" for x in run], *about)] + words[k + 3][:4]
        out.append((start, end, features + [words[k + 3 + d][4 + j] for j, d in enumerate(FAR)]))
    return out


class Chain:
    """Weights of token features and of moves between tags; outside stands on both sides of a run."""

    def __init__(self):
        self.tokens, self.moves = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
        self.moves[OUT, INSIDE] = -1e3  # nothing goes on outside a secret

    def scores(self, features: list[int]) -> np.ndarray:
        return self.tokens[features].sum(axis=0)

    def fit(self, runs: list[list[list[int]]], labels: list[list[int]], rate: float = 0.3, decay: float = 1e-3) -> Chain:
        """Batch ascent of the conditional likelihood with step sizes by feature; runs of like length go together, made equal by tokens that can only be outside."""
        groups: dict[int, list[int]] = {}
        for k, run in enumerate(runs):
            groups.setdefault(-(-len(run) // 8) * 8, []).append(k)
        batches = []
        for size, own in sorted(groups.items()):
            counts = [len(features) for k in own for features in [*runs[k], *[()] * (size - len(runs[k]))]]
            f = np.concatenate([np.asarray(features, dtype="i4") for k in own for features in runs[k]])
            gold = np.array([[*labels[k], *[OUT] * (size - len(labels[k]))] for k in own])
            only_out = np.where(np.array(counts) > 0, 0, -1e3).reshape(len(own), size)
            batches.append((size, len(own), np.repeat(np.arange(len(counts)), counts), f, gold, only_out))
        seen_tokens, seen_moves = np.full_like(self.tokens, 1e-6), np.full_like(self.moves, 1e-6)
        for _ in range(PASSES if runs else 0):
            gradient, moves = -decay * self.tokens, np.zeros((3, 3))
            for size, n, at, f, gold, only_out in batches:
                emit = np.stack([np.bincount(at, self.tokens[f, tag], n * size) for tag in range(3)], axis=1).reshape(n, size, 3)
                emit[:, :, 1:] += only_out[:, :, None]
                here, step = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(self.moves)
                ahead, back = np.zeros((n, size, 3)), np.zeros((n, size, 3))  # both up to a factor by token
                ahead[:, 0] = here[:, 0] * step[OUT]
                for k in range(1, size):
                    ahead[:, k] = (ahead[:, k - 1] / ahead[:, k - 1].sum(axis=1, keepdims=True)) @ step * here[:, k]
                back[:, -1] = step[:, OUT]
                for k in range(size - 2, -1, -1):
                    back[:, k] = (here[:, k + 1] * back[:, k + 1]) @ step.T
                    back[:, k] /= back[:, k].sum(axis=1, keepdims=True)
                likely = ahead * back
                likely /= likely.sum(axis=2, keepdims=True)
                error = -likely
                np.put_along_axis(error, gold[..., None], np.take_along_axis(error, gold[..., None], 2) + 1, 2)
                error = error.reshape(-1, 3) / len(runs)
                for tag in range(3):
                    gradient[:, tag] += np.bincount(f, error[at, tag], BUCKETS)
                both = ahead[:, :-1, :, None] * step * (here[:, 1:] * back[:, 1:])[:, :, None, :]
                both /= both.sum(axis=(2, 3), keepdims=True)
                moves += (np.bincount((3 * gold[:, :-1] + gold[:, 1:]).ravel(), minlength=9).reshape(3, 3) - both.sum(axis=(0, 1))) / len(runs)
            seen_tokens += gradient**2
            seen_moves += moves**2
            self.tokens += rate * gradient / np.sqrt(seen_tokens)
            self.moves += rate * moves / np.sqrt(seen_moves)
            self.moves[OUT, INSIDE] = -1e3
        self.tokens, self.moves = np.round(self.tokens * FINE) / FINE, np.round(self.moves * FINE) / FINE
        return self

    def decode(self, run: list[list[int]]) -> list[int]:
        """Viterbi over one run of tokens' features."""
        forward, ways = passed(np.array([self.scores(features) for features in run]), self.moves, OUTSIDE)
        return best_tags(forward, ways, self.moves).tolist()


OUTSIDE = np.array([0, NEVER, NEVER])


def passed(emit: np.ndarray, moves: np.ndarray, forward: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Viterbi over tokens' scores [token, tag] from the best scores by tag of the token before.

    Gives the best scores by tag of the last token, and parts in order: the tags [last tag, token] of the best ways to each last tag, and the tag before them.
    """
    whole, out = len(emit) // BLOCK * BLOCK, []
    for part, size in ((emit[:whole], BLOCK), (emit[whole:], len(emit) - whole)):
        if not len(part):
            continue
        e = np.ascontiguousarray(part.reshape(-1, size, 3).transpose(1, 2, 0))  # step, tag, block
        n = e.shape[2]
        entries = np.empty((3, n))
        if n > 1:  # best scores of each block from each tag before it to each tag at its end
            block = np.broadcast_to(moves[:, :, None] + e[0][None], (3, 3, n)).copy()
            for k in range(1, size):
                block = np.stack([np.maximum(np.maximum(block[:, 0] + moves[0, t], block[:, 1] + moves[1, t]), block[:, 2] + moves[2, t]) + e[k, t] for t in range(3)], axis=1)
            for b, step in enumerate(block.transpose(2, 0, 1)):
                entries[:, b] = forward
                forward = (forward[:, None] + step).max(axis=0)
                forward = forward - forward.max()
        else:
            entries[:, 0] = forward
        best, back = entries, np.empty((size, 3, n), dtype="u1")
        for k in range(size):
            after = np.empty_like(best)
            for t in range(3):
                a, b, c = best[0] + moves[0, t], best[1] + moves[1, t], best[2] + moves[2, t]
                top = np.maximum(a, b)
                back[k, t] = np.where(c > top, 2, b > a)
                after[t] = np.maximum(top, c) + e[k, t]
            best = after
        forward = best[:, -1] - best[:, -1].max()
        tags, at, every = np.empty((size, 3, n), dtype="u1"), np.broadcast_to(np.arange(3, dtype="u1")[:, None], (3, n)), np.arange(n)
        for k in range(size - 1, -1, -1):
            tags[k] = at
            at = back[k, at, every]
        chosen, last = np.empty((3, n), dtype="u1"), [0, 1, 2]
        for b, step in enumerate(reversed(at.T.tolist())):
            chosen[:, n - 1 - b] = last
            last = [step[t] for t in last]
        out.append((np.stack([tags[:, own, every].T.ravel() for own in chosen]), np.array(last)))
    return forward, out


def best_tags(forward: np.ndarray, ways: list[tuple[np.ndarray, np.ndarray]], moves: np.ndarray) -> np.ndarray:
    """The tags of all parts in order; outside stands behind the last."""
    last, out = int((forward + moves[:, OUT]).argmax()), []
    for tags, before in reversed(ways):
        out.append(tags[last])
        last = int(before[last])
    return np.concatenate(out[::-1]) if out else np.empty(0, dtype="u1")


IN_WORD, IN_MARK, IN_VALUE, LETTER, DIGIT, UPPER = 1, 2, 4, 8, 16, 32
VALUES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


@functools.cache
def characters() -> np.ndarray:
    """By code point, what TOKEN and VALUE take the character for."""
    kinds = np.fromiter((IN_WORD if c.isalnum() else 0 if c.isspace() else IN_MARK for c in map(chr, range(0x110000))), "u1", 0x110000)
    for c in VALUES:
        kinds[ord(c)] |= IN_VALUE | LETTER * c.isalpha() | DIGIT * c.isdigit() | UPPER * c.isupper()
    return kinds


def bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edges = np.flatnonzero(np.diff(inside.view("i1"), prepend=0, append=0))
    return edges[::2], edges[1::2]


def upto(flags: np.ndarray) -> np.ndarray:
    """How many are true before each place, and at last before the end."""
    return np.concatenate([[0], np.cumsum(flags, dtype="i4")])


class Seen(dict):
    """Numbers of words in order of their first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Reader:
    """Scores of all tokens of whole texts: the sums of the weights of `featured`. words: how many words' scores are kept about; fewer take less memory and more time."""

    def __init__(self, chain: Chain, words: int | None = None):
        self.chain, self.words = chain, words or WORDS
        weight = lambda x: chain.tokens[hashed(x)]
        both = lambda x: np.stack([weight(x) + weight(f"{x} {first}") for first in (False, True)])
        self.start = weight("bias") + np.stack([weight("first:False"), weight("first:True")])
        self.short, self.none = both("short"), both("none")
        self.kinds = {kind: np.stack([both(f"{kind}:{x}") for x in range(n)]) for kind, n in RUN_KINDS.items()}
        self.forget()

    def forget(self) -> None:
        self.seen, self.rows, self.table = Seen({"": 0}), 0, np.empty((1 << 12, 3 * (1 + len(FAR))))
        self.scored()

    def scored(self) -> None:
        """Rows for words seen since: scores of their own, then those they give to tokens around."""
        fresh = list(islice(reversed(self.seen), len(self.seen) - self.rows))[::-1]
        if len(self.seen) > len(self.table):
            self.table = np.concatenate([self.table[: self.rows], np.empty((len(self.seen), self.table.shape[1]))])
        for k in range(0, len(fresh), 4096):
            rows = self.chain.tokens[word_features(fresh[k : k + 4096])]
            at = self.table[self.rows : self.rows + len(rows)]
            at[:, :3], at[:, 3:] = rows[:, :4].sum(axis=1), rows[:, 4:].reshape(len(rows), -1)
            self.rows += len(rows)

    def about(self, text: str) -> np.ndarray:
        return sum(self.chain.tokens[hashed(x)] for x in file_features(text))

    def run_scores(self, codes: np.ndarray, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """[run, whether a token is its first, tag]; the last row is for tokens in no run."""
        out = np.empty((len(starts) + 1, 2, 3))
        out[:], out[-1] = self.short, self.none
        some = np.flatnonzero(ends - starts >= LEAST)
        if not len(some):
            return out
        s, e, size = starts[some], ends[some], (ends - starts)[some]
        letters, digits = (np.diff(upto(kinds & flag > 0)[np.stack([s, e])], axis=0)[0] for flag in (LETTER, DIGIT))
        turns = upto((kinds[1:] ^ kinds[:-1]) & (DIGIT | UPPER) > 0)
        switches = turns[e - 1] - turns[s]
        at = np.repeat(np.arange(len(some)), size)
        own = codes[np.arange(len(at)) + np.repeat(s - np.cumsum(size) + size, size)]
        cells = np.sort(at * 128 + own)
        edges = np.flatnonzero(np.diff(cells, prepend=-1))
        counts = np.diff(edges, append=len(cells))
        sums = np.bincount(cells[edges] // 128, counts * np.log2(counts), len(some))
        halves = np.round(2 * (np.log2(size) - sums / size), 6).astype("i8")
        a, b = bounds(kinds & LETTER > 0)
        longest = np.zeros(len(starts) + 1, dtype="i8")
        np.maximum.at(longest, starts.searchsorted(a, "right") - 1, b - a)
        found = (np.minimum(size, 64) // 8, (letters > 0) & (digits > 0), halves, np.minimum(9, 20 * switches // size), np.minimum(4, size - letters - digits), np.minimum(5, longest[some] // 3))
        out[some] = sum(self.kinds[kind][x.astype("i8")] for kind, x in zip(RUN_KINDS, found, strict=True))
        return out

    def read(self, text: str, begins: list[int], about: np.ndarray, left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Starts, ends and scores of the tokens of texts that begin at `begins` in a joined one, and its last three words.

        Three tokens that are outside for certain stand between texts. left, right: three and two words around the whole.
        """
        words = TOKEN.findall(text)
        if len(self.seen) > self.words:
            self.forget()
        ids = np.fromiter(map(self.seen.__getitem__, [*left, *words, *right]), "i4", len(words) + 5)
        self.scored()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = characters()[codes]
        starts = kinds & (IN_WORD | IN_MARK) > 0
        ends, inner = starts.copy(), (kinds[1:] & kinds[:-1] & IN_WORD) > 0
        starts[1:] &= ~inner
        ends[:-1] &= ~inner
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        run_starts, run_ends = bounds(kinds & IN_VALUE > 0)
        runs = self.run_scores(codes, kinds, run_starts, run_ends)
        run = np.where(kinds[starts] & IN_VALUE > 0, run_starts.searchsorted(starts, "right") - 1, -1)
        first = np.ones(len(starts), dtype="i8")
        first[1:] = ~((ends[:-1] == starts[1:]) & (run[1:] == run[:-1]) & (run[1:] >= 0))
        of = np.searchsorted(begins, starts, "right") - 1
        place = np.arange(len(starts)) + 3 * of  # among tokens and those between texts
        total = len(starts) + 3 * (len(begins) - 1)
        padded = np.zeros(total + 5, dtype="i4")
        padded[:3], padded[-2:], padded[3 + place] = ids[:3], ids[-2:], ids[3:-2]
        emit = np.empty((total, 3))
        for k in range(0, total, 1 << 12):
            rows = self.table[padded[k : k + 5 + (1 << 12)]]
            n = len(rows) - 5
            emit[k : k + n] = rows[3 : n + 3, :3]
            for j, d in enumerate(FAR):
                emit[k : k + n] += rows[3 + d : n + 3 + d, 3 + 3 * j : 6 + 3 * j]
        emit[place] += self.start[first] + runs[run, first] + about[of]
        between = np.ones(total, dtype=bool)
        between[place] = False
        emit[between] = OUTSIDE
        where = np.zeros((2, total), dtype="i4")
        where[:, place] = starts, ends
        return where[0], where[1], emit, [*left, *words[-3:]][-3:]


#: Texts may be cut before such a character: no token and no run of characters of values goes over it.
APART = re.compile(r"[^\w+/.=-]")


def pieces(text: str) -> list[tuple[int, int]]:
    """Ranges of about PIECE characters that cut no token and no run."""
    out, start = [], 0
    while start < len(text):
        cut_at = APART.search(text, start + PIECE)
        stop = cut_at.start() if cut_at else len(text)
        out.append((start, stop))
        start = stop
    return out


def spans_of(tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of begin tokens with the inside ones after them."""
    inside = tags != OUT
    goes_on = (tags == INSIDE) & np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & ~goes_on)
    last = np.flatnonzero(inside & ~np.concatenate([goes_on[1:], [False]]))
    return [(s, e) for s, e in zip(starts[first].tolist(), ends[last].tolist(), strict=True) if e - s >= LEAST]


def chain_spans(texts: list[str], reader: Reader) -> list[list[tuple[int, str, int]]]:
    """The chain's spans in each text, from the best tags of all its tokens. Short texts are read together, long ones in pieces that hand on words and scores."""
    found: list[list[tuple[int, str, int]]] = [[] for _ in texts]
    groups: list[list[int]] = []
    size = 0
    for k, text in enumerate(texts):
        if not groups or size + len(text) > PIECE:
            groups.append([])
            size = 0
        groups[-1].append(k)
        size += len(text) + 1
    moves = reader.chain.moves
    for own in groups:
        about = np.stack([reader.about(texts[k]) for k in own])
        joined = texts[own[0]] if len(own) == 1 else "\n".join(texts[k] for k in own)
        begins = np.cumsum([0, *[len(texts[k]) + 1 for k in own[:-1]]])
        forward, ways, starts, ends, words = OUTSIDE, [], [], [], ["", "", ""]
        for at, stop in pieces(joined) if len(own) == 1 else [(0, len(joined))]:
            after = [m[0] for m in islice(TOKEN.finditer(joined, stop), 2)]
            s, e, emit, words = reader.read(joined[at:stop], begins, about, words, [*after, "", ""][:2])
            forward, more = passed(emit, moves, forward)
            ways += more
            starts.append(s + at)
            ends.append(e + at)
        if ways:
            for s, e in spans_of(best_tags(forward, ways, moves), np.concatenate(starts), np.concatenate(ends)):
                k = int(begins.searchsorted(s, "right")) - 1
                found[own[k]].append((s - int(begins[k]), "crf", e - int(begins[k])))
    return found


def like_an_identifier(rng: random.Random, words: list[str]) -> str:
    a, b = rng.choice(words), rng.choice(words)
    n = rng.randint(1, 9999)
    return rng.choice([str(rng.randint(10**6, 10**13)), f"{a}_{b}_{n}", f"{a}-{b}-{n}", f"{a}{n % 100}.{b}.com", f"{a.title()}{b.title()}{n}", f"{n % 10}.{n % 7}.{n % 13}-{a}{n % 5}", f"{a}/{b}/{2000 + n % 30}/{n % 12}", f"www.{a}.com/{2000 + n % 30}/{n % 12:02d}/{n % 28:02d}/{b}-{a}", f"{a}{n}{b}", f"{2000 + n % 30}-{n % 12:02d}-{n % 28:02d}T{n % 24:02d}", f"{a.title()}{b.title()}{rng.choice(words).title()}", f"https://{a}.org/{b}/{rng.choice(words)}-{n}"])


def examples_of(text: str, ranges: list[tuple[int, int]], words: list[str]) -> list[tuple[str, list[tuple[int, int]]]]:
    """A stretch and its secrets, as found and changed so that patterns alone do not tell; the same ones for the same stretch."""
    rng = random.Random(zlib.crc32(text.encode()))
    if not ranges:
        run = next((m for m in VALUE.finditer(text) if len(m[0]) >= LEAST), None)
        return [(text, [])] + ([(text[: run.start()] + like_an_identifier(rng, words) + text[run.end() :], [])] if run and words else [])
    start, end = ranges[0]
    out = [(text, ranges)]
    if not words:
        return out
    other = lambda part: NAMES.sub(lambda m: rng.choice(words), part)
    bare = lambda part: re.sub(r"""["']?\x20*[:=]\x20*["']?$""", " ", part)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    of = lambda a, least, most: "".join(rng.choice(a) for _ in range(rng.randint(least, most)))
    drawn = lambda marks: of(letters + marks, 10, 56)
    changes = [(other, text[start:end], True), (lambda x: bare(other(x)), text[start:end], True), (other, drawn(""), True), (lambda x: bare(other(x)), drawn(""), True), (other, drawn("+/"), True), (lambda x: bare(other(x)), drawn("-_"), True), (lambda x: bare(other(x)), ".".join([drawn(""), drawn("-_"), drawn("-")]), True), (other, rng.choice(["", "AK", "x_"]) + drawn("").upper(), True)]
    changes += [(f, value, True) for f in (other, lambda x: bare(other(x))) for value in (of(letters[52:], 20, 48), of(letters, 10, 16), of(letters, 6, 16) + rng.choice("#$%&*@^~") + of(letters + "#$%&*@^~", 6, 24), "-".join(of(letters[26:32] + letters[52:], n, n) for n in (8, 4, 4, 4, 12)), of("xoabpks", 3, 4) + "-" + of(letters[52:], 8, 13) + "-" + of(letters, 16, 32))]
    changes += [(f, like_an_identifier(rng, words), False) for f in (other, lambda x: bare(other(x))) for _ in range(2)]
    for change, value, secret in changes:
        left, right = change(text[:start]), text[end:] if change is other else text[end:].lstrip("\"'")
        out.append((left + value + right, [(len(left), len(left) + len(value))] if secret else []))
    return out


def labels_of(run: list, ranges: list[tuple[int, int]]) -> list[int]:
    out, last = [], None
    for start, end, _ in run:
        own = next((r for r in ranges if r[0] < end and start < r[1]), None)
        out.append(OUT if own is None else INSIDE if own is last else BEGIN)
        last = own
    return out


def might_be(text: str, ranges: list[tuple[int, int]]) -> bool:
    """Whether a run of 16 or more letters and digits that stands in no base span may be a secret all the same."""
    return any(m.end() - m.start() >= 16 and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and not any(s < m.end() and m.start() < e for s, e in ranges) for m in re.finditer(r"[A-Za-z0-9]+", text))


def windows(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of windows to learn from: all stretches, and those between them, which are plain."""
    near = stretches(text)
    for at, stop in near:
        yield "value", at, stop
    edges = [0, *[x for r in near for x in r], len(text)]
    for s, e in zip(edges[::2], edges[1::2], strict=True):
        for m in WINDOW.finditer(text, s, e):
            yield "plain", m.start(), m.end()


def fit_chain(docs: DataFrame, examples: int = EXAMPLES) -> Chain:
    """The chain fitted on at most `examples` windows with base spans, as many near values and as many plain ones, the same ones at any partitioning."""

    def run(batches):
        least: dict[str, dict[str, tuple]] = {"hit": {}, "value": {}, "plain": {}}  # a task's least keys hold all that can be among the least of all
        most = dict.fromkeys(least, "g")  # keys above need not be kept
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                ranges = value_ranges(text, base_spans(text))
                for kind, at, stop in windows(text):
                    if stop - at > 8 * MOST_TOKENS:
                        continue
                    part = text[at:stop]
                    key = hashlib.blake2b(part.encode(), digest_size=8).hexdigest()
                    inside = [(s - at, e - at) for s, e in ranges if s < stop and at < e]
                    kind = "hit" if inside else kind
                    cut_off = any(s < 0 or e > stop - at for s, e in inside)
                    if key <= most[kind] and not cut_off and not might_be(part, inside):
                        kept, row = least[kind], (key, part, file_features(text), [x for r in inside for x in r])
                        kept[key] = min(row, kept.get(key, row))
                        if len(kept) > 2 * examples:
                            least[kind] = dict(sorted(kept.items())[:examples])
                            most[kind] = max(least[kind], default="")
        if rows := [(kind, *row) for kind, kept in least.items() for _, row in sorted(kept.items())[:examples]]:
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "key", "part", "about", "ranges"])

    small_batches(docs.sparkSession)
    found = texts_of(docs).select("text").mapInArrow(run, "kind string, key string, part string, about array<string>, ranges array<int>")
    slim = found.groupBy("kind", "key").agg(F.min(F.struct("part", "about", "ranges")).alias("x"))
    slim = cut(slim)
    rows = [r for kind in ("hit", "value", "plain") for r in slim.where(F.col("kind") == kind).orderBy("key").limit(examples).select("x.*").collect()]
    dropped(slim)
    return fitted([(r.part, r.about, list(zip(r.ranges[::2], r.ranges[1::2], strict=True))) for r in rows])


def fitted(found: list[tuple[str, list[str], list[tuple[int, int]]]]) -> Chain:
    """The chain fitted on stretches, features of their texts, and the secrets in them."""
    words = sorted({w.lower() for part, _, _ in found for w in re.findall(r"[^\W\d_]{3,9}", part)} - set("password passwd secret token api apikey".split()))
    runs, labels = [], []
    for part, about, own in found:
        for text, ranges in examples_of(part, own, words):
            run = featured(text, about)[:MOST_TOKENS]
            if run:
                runs.append([np.array(f, dtype="i4") for _, _, f in run])
                labels.append(labels_of(run, ranges))
    return Chain().fit(runs, labels)


FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, ranges array<int>"


def scans(texts: list[str | None], reader: Reader) -> list[tuple]:
    texts = [text or "" for text in texts]
    joined = lambda spans: ",".join(f"{kind}:{s}:{e}" for s, kind, e in spans)
    out = []
    for text, more in zip(texts, chain_spans(texts, reader), strict=True):
        base = base_spans(text)
        every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))
        counts = Counter(kind for _, kind, _ in base)
        out.append((counts["assign"], counts["access"], counts["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), [x for s, _, e in every for x in (s, e)]))
    return out


def scan(text: str | None, chain: Chain) -> tuple:
    return scans([text], Reader(chain))[0]


def with_secrets(docs: DataFrame, out: str = "__secrets", examples: int = EXAMPLES) -> DataFrame:
    """docs with a struct column: counts, base_sha256, all spans, and their starts and ends in turn."""
    model = docs.sparkSession.sparkContext.broadcast(fit_chain(docs, examples))
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def work():
        reader = Reader(model.value)
        return lambda texts: dict(zip(names, zip(*scans(texts, reader)), strict=True))

    return over_texts(docs, work, FIELDS, out)


def find_secrets(docs: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every text."""
    found = with_secrets(texts_of(docs), examples=examples)
    return found.select("doc_id", *[f"__secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span in their texts replaced by a mark; overlapping spans by one. Null texts stay null, empty tables empty, columns of any name as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit_chain(docs))

    def work():
        reader = Reader(model.value, WORDS // 4)  # memory counts more in the pipeline

        def clean(text: str | None, ranges: list[int]) -> str | None:
            if text is None:
                return None
            out, last = [], 0
            for s, e in zip(ranges[::2], ranges[1::2], strict=True):
                if s >= last:
                    out += [text[last:s], mark]
                last = max(last, e)
            return "".join([*out, text[last:]]) if ranges else text

        return lambda texts: {"text": [clean(x, found[-1]) for x, found in zip(texts, scans(texts, reader), strict=True)]}

    out = free_name(docs, "__clean")
    found = over_texts(docs, work, "text string", out)
    return found.select(*[F.col(f"{out}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
