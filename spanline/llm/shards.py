"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number; a keyed permutation of 0..n-1 turns it into a place in the shuffled order, and the
place alone gives the shard (place mod shards) and the slot in it (place div shards). Law `rows`: counts differ by one
at most. Only DataFrame functions are used.

Defined cases: a null text has no bytes (size 8, CRC 0); a null doc_id is a row like any other; rows alike in doc_id,
size and CRC take neighbouring numbers in any order, which gives the same rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ROUNDS = 4
WALK = 64


def numbered(rows: DataFrame, by: list[str], buckets: int = 4096) -> tuple[DataFrame, int]:
    """rows with a column `row_number` from 0, without gaps, that depends on the columns `by` only; and how many rows.

    Rows are dealt to hash buckets, numbered within each, and moved by the sizes of the buckets before; so no task sees
    more than its buckets. `buckets` bounds the only table that is broadcast.
    """
    dealt = cut(rows.withColumn("__bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")))
    sizes = dealt.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select("__bucket", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    total = starts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*by)) - 1
    out = dealt.withColumn("__within", within).join(F.broadcast(starts.drop("__n")), "__bucket")
    return out.withColumn("row_number", F.col("__start") + F.col("__within")).drop("__bucket", "__start", "__within"), int(total)


def permuted(number: str, total: int, seed: int) -> Column:
    """The place of the row number in column `number` in a keyed shuffle of 0..total-1.

    The domain is a x b, the smallest such grid of near-square shape that holds `total`; each half-round adds a keyed
    hash of one half to the other, modulo its radix, so every round is a bijection. A place beyond `total` is walked
    on: at most a - 1 places lie beyond, so WALK steps are surely enough for a <= WALK, and beyond that fail with
    probability under total * (1/a)**WALK; such a row raises an error rather than take a wrong place.
    """
    a = max(1, int(total**0.5))
    while a * a < total:
        a += 1
    b = max(1, -(-total // a))

    def rounds(x: str) -> str:
        """SQL for one application of the permutation to x; let-bound through transform so that nothing is computed twice."""
        left, right = f"pmod({x}, {a}L)", f"({x} div {a}L)"
        pair = f"struct({left} AS l, {right} AS r)"
        for k in range(ROUNDS):
            pair = f"transform(array({pair}), s{k} -> struct(pmod(s{k}.l + pmod(xxhash64({seed}L, {2 * k}L, s{k}.r), {a}L), {a}L) AS l, s{k}.r AS r))[0]"
            pair = f"transform(array({pair}), t{k} -> struct(t{k}.l AS l, pmod(t{k}.r + pmod(xxhash64({seed}L, {2 * k + 1}L, t{k}.l), {b}L), {b}L) AS r))[0]"
        return f"transform(array({pair}), z -> z.r * {a}L + z.l)[0]"

    return F.expr(f"""transform(array(cast({number} AS long)), x0 ->
        aggregate(sequence(1, {WALK}), {rounds('x0')}, (p, i) -> if(p < {max(total, 1)}L, p, {rounds('p')})))[0]""")


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = 2026, buckets: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, total = numbered(slim, ["doc_id", "size", "text_crc32"], buckets)
    placed = rows.withColumnRenamed("row_number", "__number").withColumn("__place", permuted("__number", total, seed))
    placed = placed.withColumn("__place", F.when(F.col("__place") < total, F.col("__place")).otherwise(F.raise_error(F.lit("a place is still beyond the table after the longest walk")).cast("long")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("__place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"__place div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
