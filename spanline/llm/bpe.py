"""Byte-pair encoding and decoding by tree concatenation.

A text is split into pre-tokens; each is encoded by merges. What is too long is halved, the halves are encoded apart (the
parts of a long text in parallel tasks), and each join is repaired: a window around it is encoded anew and grown until
both its ends agree with the tokens that are kept, which makes the whole equal to encoding it at once. Two facts carry
this: the split scans from left to right without looking back, so two scans that meet at one boundary go on alike; and
merged tokens are right as a whole if every neighbouring pair is right on its own.

Defined cases: a null text counts as empty (no ids); a special string inside a text becomes its one id, as by the
library's default, and what lies between such strings is split and joined apart; repeated rows each get a row, texts above the size of a part
being encoded once however often they come; an empty table gives no rows; columns of any name are kept as they are.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, over_texts, texts_of

#: A pre-token of more bytes is halved.
LEAF_BYTES = 256
#: Characters of a text above which its parts are encoded in parallel tasks, and of such a part.
PART_CHARS = 32_768
#: Encoded pre-tokens that a task keeps at most; beyond that it starts anew.
KEPT_PIECES = 100_000


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary file writes bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE file: its split, its merges and its tokens' bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        self.special_ids = {x["content"]: x["id"] for x in content["added_tokens"]}
        (self.special, self.special_id), = self.special_ids.items()
        ids = {bytes(letters[c] for c in token): k for token, k in content["model"]["vocab"].items() if token not in self.special_ids}
        self.tokens: list[bytes] = [b""] * (max([*ids.values(), self.special_id]) + 1)
        for token, k in ids.items():
            self.tokens[k] = token
        self.tokens[self.special_id] = self.special.encode()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.split = self.pattern.findall
        self._merge = tiktoken.Encoding("spanline", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ids, special_tokens={})._core_bpe.encode_single_piece
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str) -> Vocabulary:
        return Vocabulary(path)

    def merge(self, piece: bytes) -> list[int]:
        return self._merge(piece) if piece else []

    def agree(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side inside a piece."""
        return self.merge(self.tokens[left] + self.tokens[right]) == [left, right]

    def join(self, a, b):
        """The tokens of one piece from those of its two parts, lists or arrays: a window around the join grows until both its ends agree."""
        if not len(a) or not len(b):
            return b if len(b) else a
        k = 0
        while True:
            left, right = max(0, len(a) - k), min(len(b), k)
            window = self.merge(b"".join(map(self.tokens.__getitem__, [*a[left:], *b[:right]]))) if k else []
            seam = [*a[max(0, left - 1) : left], *window, *b[right : right + 1]]
            ends = [(seam[0], seam[1]), (seam[-2], seam[-1])] if len(seam) > 1 else []
            if all(self.agree(*pair) for pair, open_end in zip(ends, (left > 0, right < len(b)), strict=False) if open_end):
                if isinstance(a, list):
                    return a[:left] + window + b[right:]
                return np.concatenate([a[:left], np.array(window, dtype="u4"), b[right:]])
            k = max(2 * k, 2)

    def encode_piece(self, piece: bytes):
        """The tokens of one pre-token; long ones by halves, as arrays."""
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(*[np.asarray(self.encode_piece(x), dtype="u4") for x in (piece[:half], piece[half:])])

    def piece_ids(self, piece: str) -> bytes:
        """The ids of a pre-token as little-endian 32-bit integers, kept for the next time it comes."""
        ids = np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self.pieces) >= KEPT_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known, ids = self.pieces.get, self.piece_ids
        marks = np.array([self.special_id], dtype="<u4").tobytes()
        return marks.join(b"".join([known(w) or ids(w) for w in self.split(part)]) for part in text.split(self.special))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; the caller turns them into text, wrong bytes replaced, as the library does."""
        every = np.frombuffer(ids, dtype="<u4")
        return b"".join([b"".join(map(self.tokens.__getitem__, every[k : k + 65_536].tolist())) for k in range(0, len(every), 65_536)])


class Part:
    """An encoded stretch of text: its text, the ends of its pre-tokens in it, and their ids in one array with each pre-token's end in that."""

    def __init__(self, text: str, at: np.ndarray, stops: np.ndarray, flat: np.ndarray):
        self.text, self.at, self.stops, self.flat = text, at, stops, flat

    @staticmethod
    def of(text: str, vocabulary: Vocabulary) -> Part:
        found = [(m.end(), vocabulary.encode_piece(m[0].encode())) for m in vocabulary.pattern.finditer(text)]
        return Part(text, *arrays_of([e for e, _ in found], [i for _, i in found]))

    @property
    def ends(self) -> list[int]:
        return self.at.tolist()

    @property
    def ids(self) -> list[list[int]]:
        return [x.tolist() for x in np.split(self.flat, self.stops[:-1])] if len(self.stops) else []

    def join(self, other: Part, vocabulary: Vocabulary) -> Part:
        """Both parts as one: pre-tokens that end 3 characters before the join are final; from there the split runs on until it meets a boundary of the other part."""
        if not self.text or not other.text:
            return self if self.text else other
        keep = int(np.searchsorted(self.at, len(self.text) - 3, "right"))
        start, final = (int(self.at[keep - 1]), int(self.stops[keep - 1])) if keep else (0, 0)
        tail = self.text[start:]
        window = 64
        while True:
            whole = window >= len(other.text)
            text = tail + other.text[:window]
            ends, ids, at, rest = [], [], 0, None
            for m in vocabulary.pattern.finditer(text):
                if not whole and m.end() > len(text) - 3:
                    break  # what follows the window could change this one
                if at == 0 and len(self.at) == keep + 1 and m.end() == len(tail) + other.at[0]:
                    piece = vocabulary.join(self.flat[final:], other.flat[: other.stops[0]])  # one pre-token across the join: its halves are encoded already
                else:
                    piece = vocabulary.encode_piece(m[0].encode())
                ends.append(start + m.end())
                ids.append(piece)
                at = m.end()
                if at > len(tail):
                    k = int(np.searchsorted(other.at, at - len(tail)))
                    if k < len(other.at) and other.at[k] == at - len(tail):
                        rest = k + 1
                        break
            if rest is not None or whole:
                rest = len(other.at) if rest is None else rest
                skipped = int(other.stops[rest - 1]) if rest else 0
                at, stops, flat = arrays_of(ends, ids)
                here = final + len(flat)
                return Part(
                    self.text + other.text, np.concatenate([self.at[:keep], at, other.at[rest:] + len(self.text)]), np.concatenate([self.stops[:keep], stops + final, other.stops[rest:] - skipped + here]),
                    np.concatenate([self.flat[:final], flat, other.flat[skipped:]]),
                )
            window *= 4


def arrays_of(ends: list[int], ids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(i) for i in ids], dtype="i8")
    return np.array(ends, dtype="i8"), np.cumsum(sizes), np.fromiter(chain.from_iterable(ids), dtype="u4", count=int(sizes.sum()))


def tree(parts: list[Part], vocabulary: Vocabulary) -> Part:
    while len(parts) > 1:
        parts = [parts[k].join(parts[k + 1], vocabulary) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


FIELDS = "ids binary, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string"


def finished(ids: bytes, vocabulary: Vocabulary, keep: tuple[str, ...]) -> tuple:
    decoded = vocabulary.decode(ids).decode("utf-8", "replace")
    return (ids if "ids" in keep else None, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded if "decoded" in keep else None, hashlib.sha256(decoded.encode()).hexdigest())


def encode_texts(docs: DataFrame, path: str, out: str = "__bpe", part_chars: int = PART_CHARS, keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """docs with a struct column `out`: ids (little-endian unsigned 32-bit), n_tokens, ids_sha256, decoded, decoded_sha256.

    Texts above `part_chars` characters are cut into parts that are encoded in parallel and joined per text; the others
    are encoded where they are read. What `keep` does not name of ids and decoded stays null, for those who need the digests only.
    """
    names = [x.strip().split()[0] for x in FIELDS.split(",")]

    def work():
        vocabulary = Vocabulary.load(path)

        def do(texts: list) -> dict:
            return dict(zip(names, zip(*[finished(vocabulary.encode(x or ""), vocabulary, keep) for x in texts]), strict=True))

        return do

    size = F.coalesce(F.length("text"), F.lit(0))
    short = over_texts(docs.where(size <= part_chars), work, FIELDS, out)
    key = free_name(docs, "__text")
    long = docs.where(size > part_chars).withColumn(key, F.sha2("text", 256))

    def cut_up(batches):
        """Parts of the sections between special strings."""
        special = Vocabulary.load(path).special
        names = ["row", "section", "part", "text"]
        for batch in batches:
            rows, size = [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, section in enumerate(text.split(special)):
                    for k in range(0, max(1, len(section)), part_chars):
                        rows.append((row, n, k // part_chars, section[k : k + part_chars]))
                        size += 64 + len(rows[-1][3])
                        if size >= 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)
                            rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)

    own = long.select(key, "text").groupBy(key).agg(F.first("text").alias("text"))
    parts = own.mapInArrow(cut_up, "row string, section long, part long, text string").repartition("row", "section", "part")

    def encode_part():
        vocabulary = Vocabulary.load(path)

        def do(texts: list) -> dict:
            got: dict[str, list] = {"ends": [], "sizes": [], "flat": []}
            for text in texts:  # a part's lists give way to arrays before the next part
                part = Part.of(text, vocabulary)
                got["ends"].append(part.at.astype("i4"))
                got["sizes"].append(np.diff(part.stops, prepend=0).astype("i4"))
                got["flat"].append(part.flat.astype("i4"))
            return got

        return do

    def join_parts(group: pd.DataFrame) -> pd.DataFrame:
        vocabulary = Vocabulary.load(path)
        sections: list[bytes] = []
        group = group.sort_values(["section", "part"])
        for _, own in group.groupby("section", sort=True):
            parts = [Part(text, np.asarray(ends, dtype="i8"), np.cumsum(sizes, dtype="i8"), np.asarray(flat).astype("u4")) for text, ends, sizes, flat in zip(own["text"], own["ends"], own["sizes"], own["flat"], strict=True)]
            sections.append(tree(parts, vocabulary).flat.astype("<u4").tobytes())
        ids = np.array([vocabulary.special_id], dtype="<u4").tobytes().join(sections)
        return pd.DataFrame([{key: group["row"].iloc[0], out: dict(zip(names, finished(ids, vocabulary, keep), strict=True))}])

    encoded = over_texts(parts, encode_part, "ends array<int>, sizes array<int>, flat array<int>", "e").select("row", "section", "part", "text", "e.*")
    joined = encoded.groupBy("row").applyInPandas(join_parts, f"`{key}` string, `{out}` struct<{FIELDS.replace(' ', ': ').replace(',:', ',')}>")
    whole = long.join(joined, key).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{out}`"))
    return short.unionByName(whole)


def encode_and_decode(docs: DataFrame, path: str, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    found = encode_texts(texts_of(docs), path, part_chars=part_chars, keep=())
    return found.select("doc_id", "__bpe.n_tokens", "__bpe.ids_sha256", "__bpe.decoded_sha256")
