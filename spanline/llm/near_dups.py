"""Near-duplicate groups: many universal hash minima, bands, signature verification, confirmed links, star components.

Texts with equal sets of shingles form a class, found by a fingerprint of the whole set; from there on only classes
are compared, so a group of copies of any size is one row. A class's signature holds the minima of HASHES universal
hash functions, one byte of each; classes that share a band of whole minima are candidates. In a bucket every class is
verified by signature against the smallest one, which forms families; where a bucket still holds several families, its
signatures meet in blocks, and families with a pair that signatures do not rule out become one. So every candidate
pair that passes verification lies inside a family.

Each family gets a hub, the class nearest to the most frequent minima, and every member is compared with it on both full
sets. From then on a member is its difference from the hub, the shingles that only one of both has: two members' sets differ in
just what their differences do not share, so their similarity follows exactly from sizes and differences. Members
linked with the hub are one component; all others meet each member of their family in blocks of bounded rows and bytes. A task that
holds two blocks gives a spanning forest of the links it finds, never all pairs, which leaves every component as it is.
Links are turned into components by alternating large-star and small-star.

Bands of ROWS minima in BANDS bands miss a pair of similarity 0.8 with probability (1 - 0.8**4)**28, below 1 in 2
million; a signature of 112 minima that estimates such a pair below 0.6 is 5 standard deviations off.

Defined cases: a null text or one without words has no shingles and is linked with nothing; a text with fewer words than a
shingle is one shingle; a null doc_id joins its group, but never names it unless all are null; repeated rows are copies.
An empty table gives no rows. Extra columns never reach the operator.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, free_name, over_texts, small, texts_of

ROWS, BANDS = 4, 28
HASHES = ROWS * BANDS
LEAST_ESTIMATE = 0.6
HUB_PLACES = 14
#: Rows of 32 bytes (fingerprint, doc_id, hash) that are broadcast at most: 6.4 MB.
BROADCAST_ROWS = 200_000
#: Members of a block, and shingles of their differences, at most on average.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 18
KEPT_WORDS = 100_000
#: Pairs whose texts are held as Python strings at a time.
PAIRS_AT_ONCE = 128


class Shingles:
    """Sets of shingle hashes of texts: words are split at ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int):
        import xxhash

        self.words, self.hash, self.known = words, xxhash.xxh3_64_intdigest, {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        known, make = self.known, self.hash
        if len(known) > KEPT_WORDS:
            known.clear()
        found = []
        for w in (text or "").encode().lower().split():
            h = known.get(w)
            if h is None:
                h = known[w] = make(w)
            found.append(h)
        h = np.array(found, dtype="u8")
        if not len(h):
            return h
        n = min(self.words, len(h))
        mixed = np.zeros(len(h) - n + 1, dtype="u8")
        for k in range(n):
            mixed = (mixed ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        if n < self.words:
            mixed = (mixed + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(mixed)


def signature_maker(seed: int = 1):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, HASHES, dtype="u8") * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, HASHES, dtype="u8")
    mixers = rng.integers(0, 1 << 63, (BANDS, ROWS), dtype="u8") * np.uint64(2) + np.uint64(1)

    def make(found: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Of the minima of (a x + b) mod 2**64, upper half, over a set: the lowest byte of each, and a 64-bit key of each band."""
        least = np.full(HASHES, 1 << 32, dtype="u8")
        for k in range(0, len(found), 2048):
            values = found[k : k + 2048, None] * a
            values += b
            values >>= np.uint64(32)
            np.minimum(least, values.min(axis=0), out=least)
        keys = ((least.reshape(BANDS, ROWS) + np.uint64(1)) * mixers).sum(axis=1, dtype="u8")
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return least.astype("u1").tobytes(), keys.view("i8")

    return make


def fingerprint(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def with_fingerprints(docs: DataFrame, words: int, signatures: bool, out: str = "__set") -> DataFrame:
    """docs with a struct column: n (size of the set), fp (16 bytes, null for an empty set) and, if asked for, signature and band keys."""

    def work():
        shingles, make = Shingles(words), signature_maker()

        def do(texts: list) -> dict:
            sets = [shingles.of(x) for x in texts]
            got = {"n": [len(x) for x in sets], "fp": [fingerprint(x) for x in sets]}
            if signatures:
                made = [make(x) if len(x) else (None, None) for x in sets]
                got |= {"sig": [x for x, _ in made], "bands": [x for _, x in made]}
            return got

        return do

    return over_texts(docs, work, "n long, fp binary" + ", sig binary, bands array<long>" * signatures, out)


def estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b, estimate) of the pairs whose signatures agree in `least` of their minima."""
    both = pairs.join(classes.select(F.col("fp").alias("a"), F.col("sig").alias("sig_a")), "a").join(classes.select(F.col("fp").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            left, right = (np.array([np.frombuffer(x, dtype="u1") for x in batch.column(c).to_pylist()]) for c in ("sig_a", "sig_b"))
            share = (left == right).mean(axis=1)
            good = share >= least
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good)), pa.array(share[good])], names=["a", "b", "estimate"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary, estimate double")


def compared(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b, n_a, n_b, delta) of the pairs on their full sets; delta: the shingles that one of both has."""
    both = pairs.select("a", "b").join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")
    names = ["a", "b", "n_a", "n_b", "delta"]

    def run(batches):
        shingles = Shingles(words)
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(fp: bytes, text: str) -> np.ndarray:
            if fp not in kept:
                if len(kept) >= 64:
                    kept.popitem(last=False)
                kept[fp] = shingles.of(text)
            return kept[fp]

        for batch in (whole.slice(k, PAIRS_AT_ONCE) for whole in batches for k in range(0, len(whole), PAIRS_AT_ONCE)):
            got = []
            for a, b, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")], strict=True):
                left, right = of(a, x), of(b, y)
                got.append((a, b, len(left), len(right), np.setxor1d(left, right, assume_unique=True).view("i8")))
            if got:
                kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, n_a long, n_b long, delta array<long>")


def lookup(kept: DataFrame) -> DataFrame:
    """A kept table of two fingerprints or numbers a row, marked to be broadcast if it has no more rows than may be."""
    return F.broadcast(kept) if small(kept, BROADCAST_ROWS) else kept


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, itself included, by alternating large-star and small-star until all are stars.

    Each star takes the least neighbour of every node by aggregation and a join, so no task holds the neighbours of a node.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while edges.join(lookup(cut(edges.select(F.col("v").alias("u")).distinct())), "u", "left_semi").limit(1).count() or edges.groupBy("u").count().where("count > 1").limit(1).count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = lookup(cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))))
        edges = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        kept = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
        smaller = edges.join(lookup(kept), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(smaller.unionByName(kept.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def hubs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(family, hub): the member whose minima are most often the most frequent ones of its family. Counts only, at HUB_PLACES places."""
    step = HASHES // HUB_PLACES
    places = F.expr(f"explode(transform(sequence(0, {HUB_PLACES - 1}), i -> struct(i AS i, substring(sig, i * {step} + 1, 1) AS v)))")
    minima = members.join(classes.select("fp", "sig"), "fp").select("family", "fp", places.alias("x")).select("family", "fp", "x.*")
    common = minima.groupBy("family", "i", "v").agg(F.count("*").alias("n")).groupBy("family", "i").agg(F.max(F.struct("n", "v")).alias("m")).select("family", "i", F.col("m.v").alias("v"))
    agreed = minima.join(cut(common), ["family", "i", "v"]).groupBy("family", "fp").agg(F.count("*").alias("n"))
    return agreed.groupBy("family").agg(F.max(F.struct("n", "fp")).alias("m")).select("family", F.col("m.fp").alias("hub"))


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links between numbers, those of a spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = find(x), find(y)
        if u != v:
            root[u] = v
            out.append((x, y))
    return out


def met_in_blocks(rows: DataFrame, key: str, fields: list[str], links, name: str) -> DataFrame:
    """(a, b): links among the rows of a key, found by blocks; no pair of rows is ever a row.

    A row's `block` is below its key's `blocks`. Blocks below the key's `firsts` meet themselves and all later ones.
    `links` gets two blocks as lists of rows' struct arrays (the same one twice for a block with itself) and gives the places of linked rows.
    """
    made = cut(rows.groupBy(key, "blocks", "firsts", "block").agg(F.collect_list(F.struct(name, *fields)).alias("own")))
    alone = made.where("block < firsts").select(F.col("own").alias("left"), F.lit(None).cast(made.schema["own"].dataType).alias("right"))
    ahead = made.where("block < firsts AND block + 1 < blocks").select(key, F.col("own").alias("left"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"))
    across = ahead.join(made.where("blocks > 1").select(key, "block", F.col("own").alias("right")), [key, "block"]).select("left", "right")

    def run(batches):
        for batch in batches:
            lefts, rights = batch.column("left"), batch.column("right")
            for k in range(len(batch)):
                left = lefts[k].values
                right = rights[k].values if rights[k].is_valid else None
                a, b = links(left, left if right is None else right)
                if right is None:
                    a, b = a[a < b], b[a < b]
                pairs = forest(a, b if right is None else b + len(left))
                if not pairs:
                    continue
                names = left.field(name) if right is None else pa.concat_arrays([left.field(name), right.field(name)])
                x, y = (names.take(pa.array(side)) for side in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([x, y], names=["a", "b"])

    return alone.unionByName(across).mapInArrow(run, "a binary, b binary")


def alike(left: pa.StructArray, right: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows whose signatures agree in LEAST_ESTIMATE of their minima."""
    sigs = [np.frombuffer(b"".join(x.field("sig").to_pylist()), dtype="u1").reshape(len(x), HASHES) for x in (left, right)]
    found = []
    for k in range(0, len(left), 64):
        share = (sigs[0][k : k + 64, None] == sigs[1][None]).sum(axis=2)
        a, b = np.nonzero(share >= LEAST_ESTIMATE * HASHES)
        found.append((a + k, b))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def linked_by_differences(percent: int):
    """Gives places of rows that are linked: sets of sizes n and n' whose differences from one hub share s shingles differ in |d| + |d'| - 2 s."""

    def links(left: pa.StructArray, right: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        sizes, counts, flat, owner = [], [], [], []
        for x in (left, right):
            delta = x.field("delta")
            sizes.append(x.field("n").to_numpy())
            counts.append(np.diff(delta.offsets.to_numpy()))
            flat.append(delta.flatten().to_numpy())
            owner.append(np.repeat(np.arange(len(x)), counts[-1]))
        both = np.intersect1d(flat[0], flat[1])
        shared = np.zeros((len(left), len(right)), dtype="f4")
        keep = [np.isin(f, both) for f in flat]
        for k in range(0, len(both), 4096):
            part = both[k : k + 4096]
            hot = []
            for f, o, good, rows in zip(flat, owner, keep, (len(left), len(right)), strict=True):
                at = np.searchsorted(part, f)
                own = good & (at < len(part)) & (f >= part[0]) & (f <= part[-1])
                dense = np.zeros((rows, len(part)), dtype="f4")
                dense[o[own], at[own]] = 1
                hot.append(dense)
            shared += hot[0] @ hot[1].T
        apart = counts[0][:, None] + counts[1][None] - 2 * shared.astype("i8")
        total = sizes[0][:, None] + sizes[1][None]
        common = (total - apart) // 2
        return np.nonzero((common > 0) & (100 * common >= percent * (total - common)))

    return links


def blocks_of(count: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(count / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES))


def in_blocks(rows: DataFrame, key: str, apart: Column, size: Column) -> DataFrame:
    """rows of the keys that have rows with `apart`, dealt into blocks: first those with it, then the others."""
    total = lambda x, where: F.coalesce(F.sum(F.when(where, x)), F.lit(0))
    counts = rows.groupBy(key).agg(*[total(x, where).alias(n) for n, x, where in (("n_first", F.lit(1), apart), ("s_first", size, apart), ("n_rest", F.lit(1), ~apart), ("s_rest", size, ~apart))])
    sizes = counts.where("n_first > 0 AND n_first + n_rest > 1").select(key, blocks_of(F.col("n_first"), F.col("s_first")).alias("firsts"), blocks_of(F.col("n_rest"), F.col("s_rest")).alias("rests"))
    sizes = cut(sizes.select(key, "firsts", (F.col("firsts") + F.col("rests")).alias("blocks")))
    block = F.when(apart, F.expr("pmod(xxhash64(fp), firsts)")).otherwise(F.expr("firsts + pmod(xxhash64(fp), greatest(blocks - firsts, 1))"))
    return rows.join(lookup(sizes), key).withColumn("block", block)


def families_of(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp, family): classes that verified candidate pairs connect. members: key, fp, rep of every bucket of several classes."""
    others = members.where("fp <> rep")
    near = cut(estimated(others.select(F.col("fp").alias("a"), F.col("rep").alias("b")).distinct(), classes, LEAST_ESTIMATE).select("a", "b"))
    # where a bucket's least class does not stand for all others, those it doesn't meet each other and the rest
    marked = cut(others.join(lookup(near), (F.col("fp") == F.col("a")) & (F.col("rep") == F.col("b")), "left").select("key", "fp", F.col("a").isNull().alias("far")))
    rows = in_blocks(marked, "key", F.col("far"), F.lit(0)).join(classes.select("fp", "sig"), "fp")
    more = met_in_blocks(rows, "key", ["sig"], alike, "fp")
    return components(near.unionByName(more)).select(F.col("node").alias("fp"), F.col("root").alias("family"))


def links_of(families: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links, confirmed on full sets, that connect just what all links of a family connect."""
    hub = cut(families.join(lookup(cut(hubs(families, classes))), "family"))
    measured = cut(compared(hub.where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")), texts, words))
    common = (F.col("n_a") + F.col("n_b") - F.size("delta")) / 2
    near_hub = (common > 0) & (100 * common >= percent * (F.col("n_a") + F.col("n_b") - common))
    # a family is known by its hub; those not linked with it meet each other and the linked ones
    rows = measured.select(F.col("b").alias("hub"), F.col("a").alias("fp"), F.col("n_a").alias("n"), "delta", near_hub.alias("near"))
    rows = in_blocks(rows, "hub", ~F.col("near"), F.size("delta"))
    return measured.where(near_hub).select("a", "b").unionByName(met_in_blocks(rows, "hub", ["n", "delta"], linked_by_differences(percent), "fp"))


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, th (hash of the text), fp, component_id and kept of every row."""
    slim = texts_of(docs).withColumn("th", F.xxhash64("text"))
    rows = cut(with_fingerprints(slim, words, True).select("doc_id", "th", "__set.*"))
    classes = cut(rows.where("fp IS NOT NULL").groupBy("fp").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "th")).alias("at")))
    bands = classes.select("fp", F.explode("bands").alias("key"))
    buckets = cut(bands.groupBy("key").agg(F.min("fp").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    members = cut(bands.join(buckets.select("key", "rep"), "key"))
    families = cut(families_of(members, classes))

    # one text of each class that is in a family
    need = cut(classes.join(families.select("fp"), "fp", "left_semi").select("fp", F.col("at.doc_id").alias("__doc"), F.col("at.th").alias("__th")))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("th") == F.col("__th"))
    texts = slim.join(F.broadcast(need) if small(need, BROADCAST_ROWS) else need, same).select("fp", "text").groupBy("fp").agg(F.first("text").alias("text"))
    texts = cut(texts)
    links = cut(links_of(families, classes, texts, words, percent))
    dropped(buckets, members, need, texts)

    roots = cut(components(links).select(F.col("node").alias("fp"), "root"))
    own = classes.select("fp", "least_id").join(lookup(roots), "fp", "left")
    ids = cut(own.where("root IS NOT NULL").groupBy("root").agg(F.min("least_id").alias("of_root")))
    named = cut(own.join(lookup(ids), "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("of_root")).alias("component_id")))
    out = rows.select("doc_id", "th", F.col("n").alias("n_shingles"), "fp").join(named, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "th", "fp", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their groups; of repeated rows one stays, and a group without any doc_id keeps its rows of no doc_id, each text once.

    A null or empty text is a group of its own, so its row stays; an empty table stays empty; columns of any name are kept as they are.
    """
    found = near_duplicates(docs, words, percent).where("kept OR component_id IS NULL")
    own_id, own_th, doc, th, n = (free_name(docs, f"__{x}") for x in ("id", "own", "doc", "th", "n"))
    winners = found.groupBy("doc_id", "fp", F.when(F.col("fp").isNull(), F.col("th"))).agg(F.min("th").alias("th"), F.count("*").alias("n"))
    winners = cut(winners.select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("n").alias(n)))
    marked = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_th, F.xxhash64(F.col("text").cast("string")))
    same = F.col(own_id).eqNullSafe(F.col(doc)) & (F.col(own_th) == F.col(th))
    joined = marked.join(F.broadcast(winners) if small(winners, BROADCAST_ROWS) else winners, same)
    kept = [F.col(f"`{c}`") for c in docs.columns]
    single = joined.where(F.col(n) == 1).select(*kept)
    several = joined.where(F.col(n) > 1).dropDuplicates([own_id, own_th]).select(*kept)
    return single.unionByName(several)
