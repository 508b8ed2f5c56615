"""Quality classifier: random-indexing word vectors pooled per text, and a two-layer numpy network with calibrated probabilities.

A word stands for a row that follows from a hash of it, and every row has a sparse random index vector. A row's vector is the sum of
its neighbours' index vectors over all words of all texts: each task sums what it reads into a table of ROWS rows, and tables are added up by slices of rows, so
the table has one size whatever the corpus. A text is the mean of its words' vectors and of the vectors of their shapes (case,
digits, marks), a repeat of the word before being a shape of its own. A network with one hidden layer gives a logit, a
temperature fitted on training rows that the network did not see turns it into a probability, and as either label may be drawn more often than it comes,
the logit moves by the ratio of both shares. Nothing but the text is an input.

The network takes at most TRAIN_ROWS labelled rows whose crc32(doc_id) mod 5 is not 0, half of each label as far as they go, as vectors pooled where
their texts are read; word vectors and scores cover every text whole.

Defined cases: a null text counts as empty and gets the score of a zero vector; a null doc_id is never a training row; without training rows of
both labels every score is 0.5; repeated rows each get a row, and of training rows with one doc_id the least vector counts; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, dropped, over_texts, slices, small_batches, texts_of

TRAIN_ROWS = 4_000
WORD_SIZE, SHAPE_SIZE, HIDDEN, NONZERO = 32, 16, 24, 4
#: Rows of word vectors, parts in which tables are added up, and shapes.
ROWS, SLICES, SHAPES = 1 << 16, 64, 4_096
KEPT_WORDS = 100_000
AGAIN = b"\x00again"
_CLASSES = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))


def index_vector(word: bytes, size: int) -> np.ndarray:
    """A few +1 and -1 at places given by a hash of the word."""
    rng = np.random.default_rng(zlib.crc32(word))
    out = np.zeros(size, dtype="f4")
    out[rng.choice(size, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def shape_of(word: bytes) -> bytes:
    classes, out = word.translate(_CLASSES), bytearray()
    for c in classes:
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out[:8])


def shape_row(shape: bytes) -> int:
    return zlib.crc32(shape) % SHAPES


def word_row(word: bytes) -> int:
    return zlib.crc32(word) % ROWS


def index_places() -> tuple[np.ndarray, np.ndarray]:
    """Of every row the places of its index vector that are not 0, and +1 or -1 for each."""
    rng = np.random.default_rng(41)
    return rng.random((ROWS, WORD_SIZE), dtype="f4").argpartition(NONZERO, axis=1)[:, :NONZERO].astype("i8"), rng.choice([-1, 1], (ROWS, NONZERO)).astype("i8")


def neighbour_sums(docs: DataFrame) -> np.ndarray:
    """ROWS x WORD_SIZE: the index vectors of the words right after each row's words, moved by one place, and right before them, summed over all texts."""

    def count(batches):
        places, signs = index_places()
        sums, rows = np.zeros(ROWS * WORD_SIZE, dtype="i8"), {}
        for batch in batches:
            for part in slices(batch.column("text"), SLICE_BYTES // 2):
                found: list[int] = []
                starts = []
                for text in part.to_pylist():
                    starts.append(len(found))
                    for w in (text or "").encode().split():
                        own = rows.get(w)
                        if own is None:
                            if len(rows) >= KEPT_WORDS:
                                rows.clear()
                            own = rows[w] = word_row(w)
                        found.append(own)
                at = np.array(found, dtype="i8")
                pairs = np.ones(len(at), dtype=bool)
                pairs[[x for x in starts if x < len(at)]] = False  # no pair across texts
                right = np.flatnonzero(pairs)
                left = right - 1
                for own, other, move in ((at[left], at[right], 1), (at[right], at[left], 0)):
                    into = own[:, None] * WORD_SIZE + (places[other] + move) % WORD_SIZE
                    np.add.at(sums, into.ravel(), signs[other].ravel())
        for k, own in enumerate(sums.reshape(SLICES, -1)):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()])], names=["slice", "sums"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, own in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(own, dtype="i8")
        for k, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()])], names=["slice", "sums"])

    small_batches(docs.sparkSession)
    kind = "slice int, sums binary"
    added = texts_of(docs).select("text").mapInArrow(count, kind).repartition(SLICES, "slice").mapInArrow(add, kind)
    out = np.zeros((SLICES, ROWS * WORD_SIZE // SLICES), dtype="i8")
    for r in added.collect():  # one table of fixed size
        out[r["slice"]] = np.frombuffer(r["sums"], dtype="i8")
    return out.reshape(ROWS, WORD_SIZE)


class Vectors:
    """Tables of word and shape vectors."""

    def __init__(self, sums: np.ndarray):
        self.words = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)).astype("f4")
        self.shapes = np.stack([index_vector(b"shape %d" % k, SHAPE_SIZE) for k in range(SHAPES)])
        self.again = index_vector(AGAIN, SHAPE_SIZE)
        self.known: dict[bytes, tuple[int, int]] = {}

    def pooled(self, text: str | None) -> np.ndarray:
        known = self.known
        found, last, again = [], None, 0
        for w in (text or "").encode().split():
            own = known.get(w)
            if own is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                own = known[w] = (word_row(w), shape_row(shape_of(w)))
            found.append(own)
            again += own is last
            last = own
        out = np.zeros(WORD_SIZE + SHAPE_SIZE, dtype="f8")
        if found:
            at = np.array(found)
            out[:WORD_SIZE] = self.words[at[:, 0]].mean(axis=0, dtype="f8")
            out[WORD_SIZE:] = np.bincount(at[:, 1], minlength=SHAPES) @ self.shapes / len(found) + self.again * (again / len(found))
        return out


class Network:
    """tanh hidden layer, one logit, a temperature, and a move from the labels' shares among the training rows to their shares in `counts`."""

    def __init__(self, x: np.ndarray, y: np.ndarray, counts: tuple[int, int] | None = None, seed: int = 7, passes: int = 600, rate: float = 0.02, decay: float = 1e-4):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(x.shape[1]), np.ones(x.shape[1]), 1.0
        self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.fitted, self.moved = len(set(y.tolist())) == 2, 0.0
        if not self.fitted:
            return
        if counts and min(counts) > 0:
            self.moved = float(np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum()))
        order = rng.permutation(len(x))
        rest, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
        z, t = (x[own] - self.mean) / self.scale, y[own].astype("f8")
        first, second = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p]
        for step in range(1, passes + 1):
            hidden = np.tanh(z @ self.p[0] + self.p[1])
            error = (1 / (1 + np.exp(-(hidden @ self.p[2] + self.p[3]))) - t) / len(t)
            below = np.outer(error, self.p[2]) * (1 - hidden**2)
            for k, g in enumerate([z.T @ below + decay * self.p[0], below.sum(axis=0), hidden.T @ error + decay * self.p[2], error.sum(keepdims=True)]):
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g**2
                self.p[k] = self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        logits, truth = self.logits(x[rest]), y[rest]
        loss = lambda t: np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t).mean()
        self.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss) if len(rest) else 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]).reshape(-1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.moved, -500, 500))) if self.fitted else np.full(len(x), 0.5)


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 5; a null one counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def training_ids(labels: DataFrame, rows: int) -> tuple[list, tuple[int, int]]:
    """(doc_id, quality) of the labelled rows to fit on, by a hash of doc_id, half of each label as far as they go; and how many rows have each label."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold(F.col("doc_id")) != 0)
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}
    picked = [tuple(r) for q in (0, 1) for r in own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2).collect()]
    return picked, (counts.get(0, 0), counts.get(1, 0))


def pooled_texts(vectors, docs: DataFrame, out: str) -> DataFrame:
    """docs with a struct column of each text's vector; vectors: a broadcast."""

    def work():
        own = vectors.value
        return lambda texts: {"x": [own.pooled(x) for x in texts]}

    return over_texts(docs, work, "x array<double>", out)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple:
    """The broadcast vectors and the network."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(Vectors(neighbour_sums(docs)))
    picked, counts = training_ids(labels, rows)
    ids = spark.createDataFrame(picked, "doc_id long, quality int")
    texts = texts_of(docs).join(F.broadcast(ids), "doc_id")
    found = cut(pooled_texts(vectors, texts, "v").groupBy("doc_id", "quality").agg(F.min("v.x").alias("x")))
    own = sorted((r.doc_id, r.quality, r.x) for r in found.collect())
    dropped(found)
    x = np.array([v for _, _, v in own]).reshape(len(own), WORD_SIZE + SHAPE_SIZE)
    return vectors, Network(x, np.array([q for _, q, _ in own], dtype="i8"), counts)


def with_scores(docs: DataFrame, labels: DataFrame, out: str = "__quality", rows: int = TRAIN_ROWS, scored: DataFrame | None = None) -> DataFrame:
    """`scored` (or docs) with a column of scores from a model fitted on docs and labels."""
    vectors, network = fit(docs, labels, rows)

    def work():
        own = vectors.value
        return lambda texts: {"score": network.scores(np.array([own.pooled(x) for x in texts]))}

    return over_texts(docs if scored is None else scored, work, "score double", out)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    found = with_scores(texts_of(docs), labels, rows=rows)
    score = F.col("__quality.score")
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
