"""Repair of conversations: the cheapest edits that give a system turn at most, then user and assistant in turns.

Turns are sorted, equal ones counted, and faults found by DataFrame functions. The edits come from a dynamic programme over
four states (nothing yet, after system, after user, after assistant) with square-root checkpoints: a conversation of n
turns is cut to blocks of ceil(sqrt(n)) turns, LEAST_BLOCK at least; each block's step from the costs behind it to the
costs before it is a (min, +) matrix, computed apart; a walk from the last block to the first keeps the costs at block
ends only. A second walk, forwards, computes the costs inside one block at a time anew and emits the edits, at each place
the least letter whose cost is tight. So a task never holds more than a block's turns, and long conversations stream.

Edits: K keep (0), R rerole to user or assistant (2), D delete (3, the only choice for blank and repeated turns), I insert an
empty turn of user or assistant (2); a truncated turn that stays adds 1. The states leave one role for each R and I, so the
letters alone fix the result.

Defined cases: nulls in role and text are one space; a null turn comes before others, a null conv_id is a conversation of
its own; turns of one number are ordered by role and text, equal rows one behind another (the later ones being repeats);
very long texts are rows like others; other columns, whatever their names, are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Turns of a block at least; below its square a conversation is one block.
LEAST_BLOCK = 64
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: State after an inserted or reroled turn, and that turn's role.
FORCED = {NONE: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: States in which a role's initial may follow, with the state behind it.
FOLLOWS = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Costs behind the last turn: a complete conversation ends in NONE or ASSISTANT.
END = (0, 2 * INSERT, INSERT, 0)
SPACES = " \t\n\v\f\r"
EDITS = "conv_id long, place long, no long, edit string, role string, text string, cost long"


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults planted by crc32(`conv_id:turn`) mod 20; a null counts as one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = convs.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"),
    )
    return rows.where("kind <> 0").select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def turns_of(convs: DataFrame, least_block: int) -> DataFrame:
    """A row for each different (conv_id, turn, role, text) with its copies, faults, place in the conversation and block; kept as a table."""
    rows = convs.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    ).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    known = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(known).alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")), "left")
    last = F.rtrim(F.col("text"), F.lit(SPACES))
    every, order = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    rows = rows.select(
        "conv_id", "turn", "role", "text", "copies", initial.alias("initial"), (last == "").alias("blank"), F.coalesce(F.col("first") < known, F.lit(False)).alias("again"), (~F.right(last, F.lit(1)).isin(*".!?")).alias("open_end"),
        F.count("*").over(every).alias("n"), F.row_number().over(order).cast("long").alias("place"), F.lag("turn").over(order).alias("turn_before"), F.lag(initial).over(order).alias("initial_before"),
    )
    pair = F.concat("initial_before", "initial")
    sized = F.greatest(F.ceil(F.sqrt("n")).cast("long"), F.lit(least_block).cast("long"))
    return cut(rows.withColumn("b", sized).select(
        "conv_id", "turn", "role", "text", "copies", "initial", "n", "place", "blank", (F.col("blank") | F.col("again")).alias("must_go"), (~F.col("blank") & ~F.col("again") & F.col("open_end")).alias("truncated"),
        F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.when(F.col("again"), 0).otherwise(1)).alias("repeats"),
        (F.col("copies") - 1 + F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).cast("int")).alias("illegal"),
        (F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn_before") != F.col("turn")))).alias("new_turn"),
        F.expr("(place - 1) div b").alias("block"), F.expr("(n - 1) div b").alias("last_block"),
    ))


def closed(costs: list) -> list:
    """The costs of four states, with inserts before going on."""
    none, system, user, assistant = costs
    to_user, to_assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return [min(none, INSERT + to_user), min(system, INSERT + to_user), to_user, to_assistant]


def costs_before(turn: tuple, after: list) -> tuple[list, list]:
    """For a turn (initial, copies, must_go, truncated): the costs before it, and those behind its first copy; `after` are closed costs behind all copies."""
    initial, copies, must_go, truncated = turn
    rest = [x + DELETE * (copies - 1) for x in after]
    if must_go:
        return [x + DELETE for x in rest], rest
    follows = FOLLOWS.get(initial, {})
    return closed([min(rest[s] + DELETE, rest[FORCED[s][0]] + REROLE + truncated, rest[follows[s]] + KEEP + truncated if s in follows else math.inf) for s in range(4)]), rest


def block_matrix(turns: list[tuple]) -> np.ndarray:
    """Cost from each state before a block of turns to each state behind it."""
    columns = []
    for end in range(4):
        costs = closed([0 if s == end else math.inf for s in range(4)])
        for turn in reversed(turns):
            costs, _ = costs_before(turn, costs)
        columns.append(costs)
    return np.array(columns).T


def walked(turns: list[tuple], end: list, state: int, last: bool) -> Iterator[tuple[int, str, str | None, int]]:
    """(turn's number, edit, role, cost) through one block from `state`; returns the state behind it. A role of None is the turn's own."""
    table, costs = [], list(end)
    for turn in reversed(turns):
        costs, rest = costs_before(turn, costs)
        table.append((costs, rest))
    for k, (turn, (costs, rest)) in enumerate(zip(turns, reversed(table), strict=True)):
        initial, copies, must_go, truncated = turn
        while True:
            target, role = FORCED[state]
            if costs[state] == rest[state] + DELETE:
                yield k, "D", None, DELETE
                break
            if costs[state] == costs[target] + INSERT:
                state = target
                yield k, "I", role, INSERT
                continue
            if costs[state] == rest[FOLLOWS.get(initial, {}).get(state, state)] + KEEP + truncated and state in FOLLOWS.get(initial, {}):
                state = FOLLOWS[initial][state]
                yield k, "K", None, KEEP + truncated
            else:
                state = target
                yield k, "R", role, REROLE + truncated
            break
        for _ in range(copies - 1):
            yield k, "D", None, DELETE
    while last and END[state]:
        state, role = FORCED[state]
        yield len(turns), "I", role, INSERT
    return state


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches, one list for each run of equal first `keys` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rows and row[:keys] != key:
                yield key, rows
                rows = []
            key = row[:keys]
            rows.append(row)
    if rows:
        yield key, rows


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 1_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def checkpoints(turns: DataFrame) -> DataFrame:
    """c, b and costs: the state costs behind each block of the conversations that have more than one."""
    codes = F.struct("place", "initial", "copies", "must_go", F.col("truncated").cast("int").alias("truncated"))
    blocks = turns.where("last_block > 0").groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(codes)).alias("turns"))
    sized = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("matrix", pa.list_(pa.float64()))])
    found = pa.schema([("c", pa.int64()), ("b", pa.int64()), ("costs", pa.list_(pa.float64()))])

    def matrices(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = block_matrix([(t["initial"], t["copies"], t["must_go"], t["truncated"]) for t in row["turns"]])
                yield from batched(iter([(row["conv_id"], row["block"], matrix.ravel().tolist())]), sized)

    def backwards(batches):
        def rows():
            conv, costs = object(), None
            for batch in batches:
                for c, b, matrix in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                    costs = np.array(END, dtype="f8") if c != conv else costs
                    conv = c
                    yield c, b, costs.tolist()
                    costs = (np.array(matrix).reshape(4, 4) + costs).min(axis=1)

        yield from batched(rows(), found)

    steps = blocks.mapInArrow(matrices, "conv_id long, block long, matrix array<double>")
    return steps.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(backwards, "c long, b long, costs array<double>")


def edits_of(turns: DataFrame) -> DataFrame:
    """EDITS of every conversation in `turns` (from turns_of), each conversation's in one partition and in order: place is the turn's (an inserted one has the next turn's), no counts edits from 0."""
    small_batches(turns.sparkSession)
    ends = checkpoints(turns)
    rows = turns.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    rows = rows.select("conv_id", "block", "last_block", "place", "role", "text", "initial", "copies", "must_go", F.col("truncated").cast("int").alias("truncated"), "costs")
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place")
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("no", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("cost", pa.int64())])

    def run(batches):
        def rows():
            state = no = 0
            for (conv, block, last_block), block_rows in runs(batches, 3):
                if block == 0:
                    state, no = NONE, 0
                end = [*map(int, block_rows[0][10])] if block < last_block else list(END)
                edits = walked([r[6:10] for r in block_rows], end, state, block == last_block)
                while True:
                    try:
                        k, edit, role, cost = next(edits)
                    except StopIteration as done:
                        state = done.value
                        break
                    place = block_rows[k][3] if k < len(block_rows) else block_rows[-1][3] + 1
                    own = edit != "I"
                    yield conv, place, no, edit, role or block_rows[k][4], block_rows[k][5] if own else "", cost
                    no += 1

        yield from batched(rows(), schema)

    return sorted_rows.mapInArrow(run, EDITS)


def summed_up(edits: DataFrame) -> DataFrame:
    """conv_id, cost, audit and repaired_sha256 of edits as edits_of leaves them, in one pass and without another shuffle."""
    schema = pa.schema([("c", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        def rows():
            conv, cost, audit, digest, started = object(), 0, [], None, False
            for batch in batches:
                for c, edit, role, text, price in zip(*[batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6)], strict=True):
                    if c != conv:
                        if digest:
                            yield conv, cost, "".join(audit), digest.hexdigest()
                        conv, cost, audit, digest, started = c, 0, [], hashlib.sha256(), False
                    cost += price
                    audit.append(edit)
                    if edit != "D":
                        digest.update(f"{chr(10) * started}{role}:{text}".encode())
                        started = True
            if digest:
                yield conv, cost, "".join(audit), digest.hexdigest()

        yield from batched(rows(), schema)

    return edits.mapInArrow(run, "c long, cost long, audit string, repaired_sha256 string")


def faults_of(turns: DataFrame) -> DataFrame:
    """Counts of each conversation's faults; gaps are turn numbers between the least and the greatest that no turn has."""
    total = lambda x: F.sum(x).cast("long")
    return turns.groupBy(F.col("conv_id").alias("k")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - total(F.col("new_turn").cast("int")), F.lit(0)).alias("gaps"), total(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        total("repeats").alias("duplicate"), total(F.col("truncated").cast("int")).alias("truncated"), total("illegal").alias("illegal"),
    )


def repaired(convs: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """EDITS of every conversation: the repaired conversation is the rows whose edit is not D, by no."""
    return edits_of(turns_of(convs, least_block))


def audited(convs: DataFrame, given: DataFrame, least_block: int = LEAST_BLOCK) -> DataFrame:
    """A row for each conv_id of `given`: the faults of `convs`, the edits' cost and letters and the repaired conversation's digest."""
    turns = turns_of(convs, least_block)
    zero = F.lit(0).cast("long")
    ids = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = ids.join(faults_of(turns), F.col("conv_id").eqNullSafe(F.col("k")), "left").join(summed_up(edits_of(turns)), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return rows.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
