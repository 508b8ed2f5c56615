"""A prefix trie of conversations in node tables with minimal perfect hash slots.

Each conversation's turns are chained into digests, one for each prefix, so equal prefixes of any conversations have equal
digests and counting them is a grouping with partial sums. The trie is then cut to shards of whole subtrees: a node under
which more than `most` turns may lie belongs to the top, any other to the shard of its highest ancestor below the top, and
shards pack such subtrees by a hash. Within a shard the digests get slots of a minimal perfect hash (each lookup is checked
against the stored digest), counts are scattered into flat arrays by slot, and leaves and saved tokens are added up from
children to parents through an array of parent slots, a depth at a time. The top has its own table of the same kind, into
which the shards' subtrees go as sums by parent.

A shard has at most about twice `most` nodes. The top has at most (sum over conversations of n * n / 2) / `most` nodes for
conversations of n turns: a hot first turn adds a node to it, not its subtree.

Defined cases: null roles and texts are empty; a null turn comes before others; turns of one number are ordered by role
and text, equal rows being turns of their own; a row without conv_id belongs to no conversation; very long texts are only
digested and counted; other columns, whatever their names, are left out; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Turns that may lie under a node outside the top, and nodes of a shard on average.
MOST_BELOW, SHARD_NODES = 50_000, 20_000
#: Conversations of one family share turns of its first, up to SHARED - 1 of them.
FAMILY, SHARED = 100, 6
ROOT = bytes(32)
NODES = "digest binary, parent binary, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"


class SlotTable:
    """A minimal perfect hash of different 32-byte keys onto 0..n-1, with the keys by slot to check what is found.

    Keys alone in their place of a level's bit array get the slot of that bit's rank; the others go on to the next level.
    """

    LEVELS = 64

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, int]] = []
        self.keys = np.empty_like(keys)
        left, first = keys, 0
        while len(left):
            if len(self.levels) == self.LEVELS:
                raise ValueError("keys repeat")
            at = self.place(left, len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left)) == 1
            ranks = np.where(alone, first + np.cumsum(alone) - 1, -1)
            self.levels.append((ranks, 2 * len(left)))
            placed = alone[at]
            self.keys[ranks[at[placed]]] = left[placed]
            left, first = left[~placed], first + int(placed.sum())

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        """Keys are four 64-bit words of a SHA-256 digest; each level mixes them in another way."""
        mixed = (keys[:, level % 4] ^ (keys[:, (level + 1) % 4] * np.uint64(2 * level + 1))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(20)) % np.uint64(size)).astype("i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that is not in the table."""
        slots, open_keys = np.full(len(keys), -1, dtype="i8"), np.arange(len(keys))
        for level, (ranks, size) in enumerate(self.levels):
            if not len(open_keys):
                break
            found = ranks[self.place(keys[open_keys], level, size)]
            hit = found >= 0
            same = (self.keys[found[hit]] == keys[open_keys[hit]]).all(axis=1)
            slots[open_keys[hit][same]] = found[hit][same]
            open_keys = open_keys[~hit]
        return slots


def words_of(column: pa.ChunkedArray) -> np.ndarray:
    """32-byte values as rows of four 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 4)


def subtree_sums(nodes: pa.Table) -> pa.Table:
    """NODES of a table of nodes (digest, parent, conv_id, depth, n_convs, chars) and what hangs on them from elsewhere (children, leaves, saved)."""
    keys, parents = words_of(nodes["digest"]), words_of(nodes["parent"])
    table = SlotTable(keys)
    slots = table.find(keys)
    n = len(keys)

    def by_slot(column: str) -> np.ndarray:
        flat = np.empty(n, dtype="i8")
        flat[slots] = nodes[column].to_numpy()
        return flat

    up = np.empty(n, dtype="i8")
    up[slots] = table.find(parents)
    depth, convs, n_convs = by_slot("depth"), by_slot("conv_id"), by_slot("n_convs")
    children = by_slot("children") + np.bincount(up[up >= 0], minlength=n)
    leaves = by_slot("leaves") + (children == 0)
    saved = by_slot("saved") + (n_convs - 1) * by_slot("chars")
    deepest_first = np.argsort(-depth, kind="stable")
    for level in np.split(deepest_first, np.flatnonzero(np.diff(depth[deepest_first])) + 1):
        level = level[up[level] >= 0]
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    parent_convs = np.where(up >= 0, convs[up], 0)[slots]
    return pa.table({
        "digest": nodes["digest"], "parent": nodes["parent"], "conv_id": nodes["conv_id"], "parent_conv_id": pa.array(parent_convs, pa.int64(), mask=up[slots] < 0), "depth": nodes["depth"],
        "n_convs": nodes["n_convs"], "n_children": children[slots], "n_leaves": leaves[slots], "saved_tokens": saved[slots],
    })


def turns_of(convs: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role and text of each conversation's turns in order."""
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.where("conv_id IS NOT NULL").select("conv_id", F.row_number().over(order).cast("long").alias("place"), "role", "text")


def sharing_starts(turns: DataFrame) -> DataFrame:
    """turns with the first h of every conversation replaced by those of the first conversation of its family, h = crc32(conv_id as text) mod SHARED."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    own = turns.where(F.col("place") > h)
    heads = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head")).where("h > 0")
    first = turns.where(F.col("place") < SHARED).select(F.col("conv_id").alias("head"), "place", "role", "text")
    return own.unionByName(heads.join(first, "head").where("place <= h").select("conv_id", "place", "role", "text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, n (the conversation's turns), digest, parent and chars of every prefix of every conversation; kept as a table. Turns go by place."""
    small_batches(turns.sparkSession)
    sized = turns.select("conv_id", "place", "role", "text", F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, last = None, 0, ROOT
        for batch in batches:
            out = []
            for c, _, role, text, n in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if c != conv:
                    conv, depth, last = c, 0, ROOT
                name = role.encode()
                digest = hashlib.sha256(b"%s%d:%s%s" % (last, len(name), name, text.encode())).digest()
                depth += 1
                out.append((c, depth, n, digest, last, len(text)))
                last = digest
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 6, schema, strict=True)], schema=schema)

    return cut(sized.sortWithinPartitions("conv_id", "place").mapInArrow(run, "conv_id long, depth long, n long, digest binary, parent binary, chars long"))


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """digest and ends_sha256 from rows (digest, conv_id): SHA-256 of the ids in ascending order, joined by commas. Rows stream through a task in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if d != node:
                    if sha:
                        done.append((node, sha.hexdigest()))
                    node, sha = d, hashlib.sha256(str(c).encode())
                else:
                    sha.update(b",%d" % c)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], names=["digest", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["digest", "ends_sha256"])

    return ends.repartition("digest").sortWithinPartitions("digest", "conv_id").mapInArrow(run, "digest binary, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame, most: int = MOST_BELOW, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """NODES and ends_sha256 of the trie over `turns` (conv_id, place, role, text); `ids` has every conversation once, those without turns too."""
    every = prefixes(turns)
    big = every.groupBy("digest").agg(F.sum(F.col("n") - F.col("depth") + 1).alias("below")).where(F.col("below") > most).select("digest", F.lit(True).alias("big"))
    path = Window.partitionBy("conv_id")
    placed = every.join(big, "digest", "left").withColumn("top", F.coalesce(F.max(F.when(F.col("big"), F.col("depth"))).over(path), F.lit(0)))
    placed = placed.withColumn("subtree", F.when(F.col("big").isNull(), F.max(F.when(F.col("depth") == F.col("top") + 1, F.col("digest"))).over(path)))
    nodes = cut(placed.groupBy("subtree", "digest").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"),
    ).withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}))
    shards = max(1, -(-nodes.count() // shard_nodes))
    in_shards = nodes.where("subtree IS NOT NULL").groupBy(F.pmod(F.xxhash64("subtree"), F.lit(shards)).alias("shard")).applyInArrow(subtree_sums, NODES)
    below = cut(in_shards)
    hung = below.where("parent_conv_id IS NULL").groupBy("parent").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("digest"), F.lit(b"\xff" * 32).alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("chars"),
    )
    above = nodes.where("subtree IS NULL").select(*root.columns).unionByName(root)
    above = above.join(hung.withColumnRenamed("parent", "digest"), "digest", "left").fillna(0, ["children", "leaves", "saved"])
    above = cut(above.groupBy(F.lit(0).alias("shard")).applyInArrow(subtree_sums, NODES))
    heads = above.select(F.col("digest").alias("parent"), F.col("conv_id").alias("head"))
    below = below.join(heads, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "head")).drop("head")
    silent = ids.join(every.select("conv_id").where("depth = 1"), "conv_id", "left_anti").select(F.lit(ROOT).alias("digest"), "conv_id")
    ends = digests_of_ends(every.where("depth = n").select("digest", "conv_id").unionByName(silent))
    return below.unionByName(above).join(ends, "digest", "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"])


def family_trie(convs: DataFrame, most: int = MOST_BELOW, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The trie of conversations rebuilt by sharing_starts: NODES and ends_sha256, a row a node."""
    turns = turns_of(convs)
    ids = convs.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id IS NOT NULL").distinct()
    return trie(sharing_starts(turns), ids, most, shard_nodes)
