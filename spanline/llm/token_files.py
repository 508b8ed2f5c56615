"""Token ids in ORC files: sorted by document, run-length encoded integers, row indexes and Bloom filters on document ids.

Texts are dealt to tasks by ranges of doc_id, sorted, encoded and written by Spark's ORC writer, a file a task. The writer
keeps ids in runs (integer run-length encoding, no dictionary), indexes every ROWS_INDEXED rows of a stripe by least and
greatest doc_id, and adds a Bloom filter of doc_id to each; so tasks read stripes apart, and a lookup of some documents
reads the row groups that may hold them. A row also has its file's number and the ids before it in that file, so the place
of a document in the whole sequence needs the files' totals only, one row a file.

Encoding: white space never lies inside a token of such vocabularies (checked in the file itself), so a text is the ids of
its words one after another, and words' ids are kept for the next time. Texts with characters outside PLAIN or with special
strings, and all texts of other vocabularies, go through the library as a whole.

Defined cases: a null or empty text is its end id alone; null doc_ids come first; rows of one doc_id are ordered by a hash of
their text and dealt to several tasks where they are many, each with its own row; a very long text is one row (its ids take
about four bytes for each three of text), and few rows are read at a time; other columns, whatever their names, are not
written; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_ready, slices, small_batches, texts_of

FIELDS = "doc_id long, part int, at long, n long, ids array<int>"
ROWS_INDEXED = 1_000
STRIPE_BYTES = 32 << 20
#: Rows that the reader of nested columns holds at a time.
ROWS_READ = 256
#: Words' ids that a task keeps at most; beyond that it starts anew. Longer words are not kept.
KEPT_WORDS, KEPT_CHARS = 600_000, 64
#: Characters that every Unicode version lower-cases one by one, leaves composed and sorts alike into letters, digits, white space and the rest.
PLAIN = re.compile("[\t\n\r -~\xa0-įı-ɏ‐-‧‰-⁞₠-₿]*")


class Words(dict):
    """Ids of lower-case words without white space, found when first asked for.

    Letters alone, with marks before or behind them, are merged by rank over symbols of one byte: a word's last byte has a symbol of its
    own, as its tokens differ from those inside words. Ranks do what the file's merges do where each token's own merges lead to it and come
    in the order of ids (both hold for the files tested). All else, contractions and digits among it, the library encodes.
    """

    SHAPE = re.compile(r"([^\w']*)([^\W\d_²³¹¼½¾]+)([^\w']*)")
    INSIDE, LAST = {*range(97, 123), *range(0x80, 0xE0)}, {**{b: b - 32 for b in range(97, 123)}, **{b: b - 128 for b in range(0x80, 0xC0)}}

    def __init__(self, content: dict, library: Callable[[str], bytes]):
        import tiktoken

        from .bpe import byte_letters

        super().__init__()
        self.library = library
        letters, vocabulary, end = byte_letters(), content["model"]["vocab"], content["model"]["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        ids = [vocabulary[a + b] for a, b in pairs]
        self.by_ranks = bool(end) and ids == sorted(ids) and ids[0] >= 512
        ranks = {}
        for token, k in vocabulary.items() if self.by_ranks else ():
            last = token.endswith(end)
            symbols = [letters.get(c, 0) for c in token.removesuffix(end)]
            if last and symbols:
                symbols[-1], fits = self.LAST.get(symbols[-1], 0), symbols[-1] in self.LAST
            else:
                fits = bool(symbols) and symbols[-1] in self.INSIDE
            if fits and self.INSIDE.issuperset(symbols[:-1]):
                ranks[bytes(symbols)] = k
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece if ranks else None

    def __missing__(self, word: str) -> bytes:
        shape = self.SHAPE.fullmatch(word) if self.by_ranks else None
        if shape:
            before, core, behind = shape.groups()
            symbols = core.encode()
            ids = array("I", self.merge(symbols[:-1] + bytes((self.LAST[symbols[-1]],)))).tobytes()
            if before:
                ids = (self[before] if before in self else self.keep(before, self.library(before))) + ids
            if behind:
                ids += self[behind] if behind in self else self.keep(behind, self.library(behind))
        else:
            ids = self.library(word)
        return self.keep(word, ids)

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts, as bytes of little-endian 32-bit integers, equal to the library's for the whole text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in content["added_tokens"]) or "(?!)")
        self.words = Words(content, self.library) if splits_at_spaces(content) else None

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> Encoder:
        return Encoder(path)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.words is not None and PLAIN.fullmatch(text) and not self.special.search(text):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return self.library(text)


def splits_at_spaces(content: dict) -> bool:
    """Whether a vocabulary file composes, turns white space into a space, lower-cases, and then keeps the matches of a pattern without white space."""
    steps = (content.get("normalizer") or {}).get("normalizers") or []
    cuts = (content.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    pattern = cuts[0].get("pattern", {}).get("Regex", "")
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and cuts[0].get("type") == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
        and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in cuts[1:])
    )


def ids_in_order(docs: DataFrame, path: str, end_id: int, files: int | None = None) -> DataFrame:
    """FIELDS of every row of docs, in ascending order of doc_id over the partitions and inside them."""
    small_batches(docs.sparkSession)
    keys = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]  # the last deals out even one row repeated
    keyed = texts_of(docs).select("doc_id", "text", keys[1].alias("hash"), keys[2].alias("row"))
    by = ["doc_id", "hash", "row"]
    dealt = (keyed.repartitionByRange(files, *by) if files else keyed.repartitionByRange(*by)).sortWithinPartitions(*by).select("doc_id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = Encoder.load(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            start = 0
            for texts in slices(batch.column(1)):
                ids = [encoder.encode(t or "") + end for t in texts.to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], dtype="i8")
                ends = sizes.cumsum()
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype("i4")), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                own = batch.column(0).slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(ids), part, dtype="i4")), pa.array(at + ends - sizes), pa.array(sizes), lists], names=["doc_id", "part", "at", "n", "ids"])
                start, at = start + len(texts), at + int(ends[-1])

    return dealt.mapInArrow(run, FIELDS)


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 2, files: int | None = None) -> None:
    """Every text of docs as ids with an end id, in ORC files of `folder`; `files` is their number, by default the session's number of shuffle partitions or fewer."""
    options = {
        "orc.create.index": "true", "orc.row.index.stride": ROWS_INDEXED, "orc.stripe.size": STRIPE_BYTES, "orc.encoding.strategy": "COMPRESSION",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd",
    }
    ids_in_order(docs, path, end_id, files).write.options(**options).orc(folder)


def read_ids(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """FIELDS from the files of write_ids; with doc_ids (a short list, as it is part of the plan) only those documents, by the files' indexes and Bloom filters."""
    size = "spark.sql.orc.columnarReaderBatchSize"
    if int(spark.conf.get(size)) > ROWS_READ:
        spark.conf.set(size, ROWS_READ)
    rows = spark.read.schema(FIELDS).orc(folder)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def places(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of documents in the files. What is broadcast has a row a file, from two columns of integers."""
    totals = read_ids(spark, folder).groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    bases = sorted((r["part"], r["total"]) for r in totals.collect())
    sums = np.cumsum([0, *[n for _, n in bases]])
    base = spark.createDataFrame([(part, int(before)) for (part, _), before in zip(bases, sums[:-1], strict=True)], "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            ends = lists.offsets.to_numpy()
            data = lists.values.to_numpy().astype("<u4", copy=False)
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype("i8")), pa.array(crcs, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    found = read_ids(spark, folder, doc_ids).mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def own_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
