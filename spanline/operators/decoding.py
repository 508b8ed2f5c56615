"""Best paths of speakers through turns or frames, in blocks of steps.

A recording's steps are cut to blocks. Each block's scores from every state before it to every state in its last step are one
(max, +) matrix, computed apart; a walk over a recording's matrices gives the scores that enter each block; each block then finds
its best path to every state of its last step, and a walk back over the blocks chooses among these. Only matrices and states
are walked, so the frames of a long recording are spread over tasks. Scores are whole multiples of 1e-9, so sums are exact and
paths do not depend on the size of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanline.lineage import cut

SCALE, NEVER = 1_000_000_000, -(1 << 62)
#: Steps of a block.
BLOCK_STEPS = 512
STEP = "struct<t:bigint,scores:array<struct<state:string,score:bigint>>,stay:bigint,switch:bigint>"


def block_scores(names: list[str], steps: list[dict], floor: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Emissions (step, state), and (stay, switch) of each step."""
    place = {s: k for k, s in enumerate(names)}
    emit = np.full((len(steps), len(names)), NEVER if floor is None else floor, dtype="i8")
    for row, step in zip(emit, steps, strict=True):
        for x in step["scores"]:
            row[place[x["state"]]] = x["score"]
    return emit, np.array([(s["stay"], s["switch"]) for s in steps], dtype="i8")


def advance(before: np.ndarray, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Scores after a step, for each row of scores before it."""
    after = np.maximum(before + move[0], before.max(axis=-1, keepdims=True) - move[1]) + emit
    return np.where((after < NEVER // 2) | (emit < NEVER // 2), NEVER, after)


def block_matrix(emit: np.ndarray, moves: np.ndarray, first: bool) -> np.ndarray:
    size = emit.shape[1]
    scores = np.where(np.eye(size, dtype=bool), 0, NEVER)
    for k, (row, move) in enumerate(zip(emit, moves, strict=True)):
        scores = np.where((scores < NEVER // 2) | (row < NEVER // 2), NEVER, scores + row) if first and k == 0 else advance(scores, row, move)
    return scores


def paths_through(before: np.ndarray, emit: np.ndarray, moves: np.ndarray, first: bool, stay_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each state of the last step: the state before the block, and the path; and the last step's scores. Ties go to the first state, with stay_first to staying."""
    size, own = emit.shape[1], np.arange(emit.shape[1])
    scores, back = before, np.empty(emit.shape, dtype="i4")
    for k, (row, move) in enumerate(zip(emit, moves, strict=True)):
        if first and k == 0:
            back[k], scores = own, np.where(row < NEVER // 2, NEVER, scores + row)
            continue
        top = int(scores.argmax())
        stays, jumps = scores + move[0], scores[top] - move[1]
        back[k] = np.where((stays > jumps) | ((stays == jumps) & (stay_first | (own <= top))), own, top)
        scores = advance(scores[None], row, move)[0]
    path = np.empty((len(emit), size), dtype="i4")
    state = own
    for k in range(len(emit) - 1, -1, -1):
        path[k] = state
        state = back[k][state]
    return state, path.T, scores


def best_paths(steps: DataFrame, floor: float | None = None, stay_first: bool = True, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """(key, t, state): the best path of each key through its steps (key, t, scores: array of (state, score), stay, switch).

    A step's score is that of its state (floor if it has none; without a floor such states are not allowed), plus stay if the state
    before is the same, minus switch if not; the first step has neither. A key without any allowed path is an error.
    """
    kind = dict(steps.dtypes)["key"]
    whole = lambda c: F.round(F.col(c) * SCALE).cast("long").alias(c)
    scaled = F.transform("scores", lambda x: F.struct(x["state"].alias("state"), F.round(x["score"] * SCALE).cast("long").alias("score")))
    order = Window.partitionBy("key").orderBy("t")
    placed = cut(steps.select("key", F.col("t").cast("long").alias("t"), scaled.alias("scores"), whole("stay"), whole("switch"), F.expr(f"(row_number() OVER (PARTITION BY key ORDER BY t) - 1) div {block_steps}").alias("block")))
    names = placed.select("key", F.explode("scores.state").alias("state")).groupBy("key").agg(F.sort_array(F.collect_set("state")).alias("names"))
    blocks = placed.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("t", "scores", "stay", "switch"))).cast(f"array<{STEP}>").alias("steps"))
    blocks = cut(blocks.join(names, "key"))
    low = None if floor is None else round(floor * SCALE)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [block_matrix(*block_scores(r["names"], r["steps"], low), r["block"] == 0).ravel().tolist() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(found, pa.list_(pa.int64()))], names=["key", "block", "matrix"])

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = None
        for batch in batches:
            found = []
            for block, matrix in zip(batch.column("block").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                size = int(len(matrix) ** 0.5)
                scores = np.zeros(size, dtype="i8") if block == 0 else scores
                found.append(scores.tolist())
                ways = scores[:, None] + np.array(matrix, dtype="i8").reshape(size, size)
                scores = np.where((scores[:, None] < NEVER // 2) | (np.array(matrix).reshape(size, size) < NEVER // 2), NEVER, ways).max(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(found, pa.list_(pa.int64()))], names=["k", "b", "before"])

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, paths, last = [], [], []
            for r in batch.to_pylist():
                emit, moves = block_scores(r["names"], r["steps"], low)
                entry, path, scores = paths_through(np.array(r["before"], dtype="i8"), emit, moves, r["block"] == 0, stay_first)
                if scores.max() < NEVER // 2:
                    raise ValueError(f"no path is allowed through {r['key']}")
                entries.append(entry.tolist())
                paths.append(path.tolist())
                last.append(int(scores.argmax()))
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(entries, kinds), pa.array(paths, pa.list_(kinds)), pa.array(last, pa.int32())], names=["key", "block", "entries", "paths", "last"])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), 0
        for batch in batches:
            found = []
            for k, entries, last in zip(*[batch.column(c).to_pylist() for c in ("key", "entries", "last")], strict=True):
                state = state if k == key else last
                found.append(state)
                key, state = k, entries[state]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(found, pa.int32())], names=["k", "b", "state"])

    walk = lambda df, order: df.repartition("key").sortWithinPartitions("key", order)
    entering = walk(blocks.mapInArrow(matrices, f"key {kind}, block long, matrix array<long>"), "block").mapInArrow(forwards, f"k {kind}, b long, before array<long>")
    ways = cut(blocks.join(entering, F.expr("key = k AND block = b")).select("key", "block", "steps", "names", "before").mapInArrow(through, f"key {kind}, block long, entries array<int>, paths array<array<int>>, last int"))
    chosen = walk(ways.select("key", "block", "entries", "last"), F.desc("block")).mapInArrow(backwards, f"k {kind}, b long, state int")
    path = ways.join(chosen, F.expr("key = k AND block = b")).select("key", "block", F.col("paths")[F.col("state")].alias("path"))
    rows = blocks.select("key", "block", "names", F.col("steps.t").alias("ts")).join(path, ["key", "block"])
    return rows.select("key", "names", F.explode(F.arrays_zip("ts", "path")).alias("x")).select("key", F.col("x.ts").alias("t"), F.col("names")[F.col("x.path")].alias("state"))


#: Defaults of turn decoding: candidates of a turn, staying and switching at no gap, the gap at which both fade to 1/e, and the least score and margin of anchors and supports.
TOP, STAY, SWITCH, FADE_MS, ANCHOR, SUPPORT, FLOOR = 3, 0.022, 0.012, 1800, (0.82, 0.18), (0.65, 0.08), -2.0


def turn_candidates(turns: DataFrame, top: int = TOP, anchor: tuple[float, float] = ANCHOR, support: tuple[float, float] = SUPPORT) -> DataFrame:
    """turns (key, turn_id, start_ms, end_ms, speaker_id, locked, strong, scores) with the candidates of each turn, and whether it is an anchor and a support.

    A lock leaves its speaker alone, whatever the scores; an anchor, given (strong) or found (own speaker first by score and margin), its own;
    else the `top` best and the own speaker are candidates. A strong anchor that contradicts a lock, or has no score of its own speaker, is an error.
    """
    sorted_scores = F.transform(F.array_sort(F.transform("scores", lambda x: F.struct((-x["score"]).alias("p"), x["speaker_id"].alias("s")))), lambda x: F.struct(x["s"].alias("state"), (-x["p"]).alias("score")))
    best = F.transform(F.array(sorted_scores), lambda r: F.filter(r, lambda x, i: F.array_position(F.transform(r, lambda y: y["state"]), x["state"]) == i + 1))[0]  # a speaker's best score alone
    rows = turns.withColumn("ranked", best)
    margin = F.get("ranked", F.lit(0))["score"] - F.coalesce(F.try_element_at("ranked", F.lit(2))["score"], F.lit(FLOOR))
    sure = lambda least: (F.get("ranked", F.lit(0))["state"] == F.col("speaker_id")) & (F.get("ranked", F.lit(0))["score"] >= least[0]) & (F.round(margin, 12) >= least[1])
    own = F.exists("ranked", lambda x: x["state"] == F.col("speaker_id"))
    wrong = F.when(F.size("ranked") < 1, "a turn has no scores").when(F.col("strong") & (F.col("locked") != F.col("speaker_id")), "a lock contradicts an anchor").when(F.col("strong") & ~own, "an anchor has no score of its own speaker")
    score_of = lambda s: F.coalesce(F.get(F.filter("ranked", lambda x: x["state"] == s), F.lit(0))["score"], F.lit(FLOOR))
    one = lambda s: F.array(F.struct(s.alias("state"), score_of(s).alias("score")))
    is_anchor = F.col("strong") | (F.col("locked").isNull() & sure(anchor))
    few = F.slice("ranked", 1, top)
    rows = rows.withColumn("anchor", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(is_anchor))
    scores = F.when(F.col("locked").isNotNull(), one(F.col("locked"))).when(F.col("anchor"), one(F.col("speaker_id"))).when(F.exists(few, lambda x: x["state"] == F.col("speaker_id")), few).otherwise(F.array_append(few, one(F.col("speaker_id"))[0]))
    supports = F.coalesce(F.col("locked") == F.col("speaker_id"), F.lit(True)) & sure(support)
    return rows.withColumns({"candidates": scores, "support": supports, "margin": margin, "own_score": score_of(F.col("speaker_id")), "has_own": own})


def decode_turns(turns: DataFrame, top: int = TOP, stay: float = STAY, switch: float = SWITCH, fade_ms: int = FADE_MS, anchor: tuple[float, float] = ANCHOR, support: tuple[float, float] = SUPPORT, protect: str | None = "supports", block_steps: int = BLOCK_STEPS) -> DataFrame:
    """(key, turn_id, speaker_id, decoded, score, reasons): the best speaker of every turn under locks and anchors.

    Turns go by start, end and id; staying pays and switching costs the more the shorter the gap. Afterwards a speaker whose turns were all given to
    others gets one back: with protect `supports` if it has a sure one, with `all` in any case where it has a score, its sure turns first; None leaves the path as it is.
    """
    rows = turn_candidates(turns, top, anchor, support)
    order = Window.partitionBy("key").orderBy("start_ms", "end_ms", "turn_id")
    near = F.exp(-F.greatest(F.lit(0), F.coalesce(F.col("start_ms") - F.lag("end_ms").over(order), F.lit(0))) / fade_ms)
    rows = cut(rows.select("*", F.row_number().over(order).cast("long").alias("t"), near.alias("near")))
    path = best_paths(rows.select("key", "t", F.col("candidates").alias("scores"), (stay * F.col("near")).alias("stay"), (switch * F.col("near")).alias("switch")), stay_first=False, block_steps=block_steps)
    found = cut(rows.join(path.withColumnRenamed("state", "decoded"), ["key", "t"]))
    found = restored(found, protect) if protect else found.withColumn("back", F.lit(False))
    score = F.coalesce(F.get(F.filter("ranked", lambda x: x["state"] == F.col("decoded")), F.lit(0))["score"], F.lit(FLOOR))
    reasons = F.array_compact(F.array(F.when(F.col("locked").isNotNull(), "LOCKED"), F.when(F.col("anchor"), "ANCHOR"), F.when(F.col("decoded") != F.col("speaker_id"), "REASSIGNED"), F.when(F.col("back"), "RESTORED")))
    return found.select("key", "turn_id", "speaker_id", "decoded", score.alias("score"), reasons.alias("reasons"))


def restored(found: DataFrame, protect: str) -> DataFrame:
    """found with one turn given back to each speaker that lost all of them, speakers by name: the one of best score, then margin, then start. A row a speaker decides, not a row a turn."""
    open_turn = F.coalesce(F.col("locked") == F.col("speaker_id"), F.lit(True)) & F.col("has_own")
    kinds = F.col("support") if protect == "supports" else open_turn
    place = F.struct((~F.col("support")).alias("unsure"), (-F.col("own_score")).alias("score"), (-F.col("margin")).alias("margin"), "start_ms", "turn_id", "t", F.col("decoded").alias("holder"))
    own = found.where(kinds).groupBy("key", "speaker_id").agg(F.min(place).alias("p")).select("key", "speaker_id", "p.t", "p.holder")
    held = found.groupBy("key", F.col("decoded").alias("speaker_id")).agg(F.count("*").alias("n"))
    table = own.join(held, ["key", "speaker_id"], "full_outer").fillna(0, ["n"])
    kind = dict(found.dtypes)["key"]

    def give_back(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("speaker_id")
        count = dict(zip(part["speaker_id"], part["n"], strict=True))
        out = []
        for key, speaker, t, holder in zip(part["key"], part["speaker_id"], part["t"], part["holder"], strict=True):
            if count[speaker] == 0 and not pd.isna(t):
                count[speaker] += 1
                count[holder] -= 1
                out.append((key, int(t)))
        return pd.DataFrame(out, columns=["key", "t"])

    back = table.groupBy("key").applyInPandas(give_back, f"key {kind}, t long").withColumn("back", F.lit(True))
    both = found.join(back, ["key", "t"], "left").withColumn("back", F.coalesce("back", F.lit(False)))
    return both.withColumn("decoded", F.when(F.col("back"), F.col("speaker_id")).otherwise(F.col("decoded")))


def boundary_scores(frames: DataFrame, turns: DataFrame, hop_ms: int, snap_ms: float, weights: dict[str, float], reach: float = 40.0) -> DataFrame:
    """frames (key, frame) with `boundary`: the nearness of turn bounds to the middle of the frame, exp(-distance / snap), weighted by system and as a share of all bounds of the recording.

    Exponentials of a distance are products, so the sums run over the sorted bounds of a bucket of `reach` snap lengths once from each side, and a neighbouring
    bucket comes in by its total; no frame meets the bounds one by one. A bound beyond those buckets would add less than exp(-reach) of its weight and is left out.
    """
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("system")]
    bounds = turns.select("key", F.explode(F.array("start_ms", "end_ms")).alias("ms"), weight.alias("w")).select("key", (F.col("ms") / snap_ms).alias("at"), "w").groupBy("key", "at").agg(F.sum("w").alias("w"))
    total = bounds.groupBy("key").agg(F.sum("w").alias("total"))
    middles = frames.select("key", ((F.col("frame") + 0.5) * hop_ms / snap_ms).alias("at"), F.lit(0.0).alias("w"), "frame")
    both = bounds.withColumn("frame", F.lit(None).cast(dict(frames.dtypes)["frame"])).unionByName(middles)
    both = both.withColumn("bucket", F.floor(F.col("at") / reach)).withColumn("x", F.col("at") - F.col("bucket") * reach)
    bucket, is_frame, ahead = Window.partitionBy("key", "bucket"), F.col("frame").isNotNull(), Window.unboundedPreceding
    left = F.sum(F.col("w") * F.exp("x")).over(bucket.orderBy("x", is_frame).rowsBetween(ahead, 0)) * F.exp(-F.col("x"))
    right = F.sum(F.col("w") * F.exp(-F.col("x"))).over(bucket.orderBy(F.desc("x"), is_frame.desc()).rowsBetween(ahead, 0)) * F.exp("x")
    sides = both.withColumn("own", left + right).where(is_frame)
    sums = both.where(~is_frame).groupBy("key", "bucket").agg(F.sum(F.col("w") * F.exp("x")).alias("up"), F.sum(F.col("w") * F.exp(-F.col("x"))).alias("down"))
    before, after = sums.select("key", (F.col("bucket") + 1).alias("bucket"), "up"), sums.select("key", (F.col("bucket") - 1).alias("bucket"), "down")
    far = F.coalesce(F.col("up"), F.lit(0.0)) * F.exp(-F.col("x") - reach) + F.coalesce(F.col("down"), F.lit(0.0)) * F.exp(F.col("x") - reach)
    near = sides.join(before, ["key", "bucket"], "left").join(after, ["key", "bucket"], "left").join(total, "key", "left")
    return near.select("key", "frame", F.least(F.lit(1.0), F.coalesce(F.round((F.col("own") + far) / F.col("total"), 9), F.lit(0.0))).alias("boundary"))


def decode_frame_grid(p: DataFrame, boundaries: DataFrame | None = None, switch: float = 0.5, stay: float = 0.0, relief: float = 0.0, silence: float = 0.34, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """(recording_id, frame, speaker_id): one speaker, or `-` for none, for each frame from a recording's first to its last in p (recording_id, frame, speaker_id, p).

    Switching costs less where bounds are near: switch - relief * boundary (recording_id, frame, boundary), 0 at least.
    """
    ends = p.groupBy("recording_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).select("recording_id", F.explode(F.sequence("a", "b")).alias("frame"))
    own = p.groupBy("recording_id", "frame").agg(F.collect_list(F.struct(F.col("speaker_id").alias("state"), F.col("p").alias("score"))).alias("scores"))  # one a speaker
    none = F.array(F.struct(F.lit("-").alias("state"), F.lit(silence).alias("score")))
    steps = ends.join(own, ["recording_id", "frame"], "left").withColumn("scores", F.coalesce(F.concat(none, "scores"), none))
    steps = steps.join(boundaries.select("recording_id", "frame", "boundary"), ["recording_id", "frame"], "left") if boundaries is not None else steps.withColumn("boundary", F.lit(0.0))
    cost = F.greatest(F.lit(0.0), F.lit(switch) - relief * F.coalesce("boundary", F.lit(0.0)))
    path = best_paths(steps.select(F.col("recording_id").alias("key"), F.col("frame").alias("t"), "scores", F.lit(stay).alias("stay"), cost.alias("switch")), 0.0, True, block_steps)
    return path.select(F.col("key").alias("recording_id"), F.col("t").alias("frame"), F.col("state").alias("speaker_id"))


def with_lost_speakers(labels: DataFrame, p: DataFrame, least: float = 0.0) -> DataFrame:
    """labels (recording_id, frame, speaker_id) of decode_frame_grid, and `restored`: a speaker of p with no frame of its own gets the longest run of frames (then the one of greatest mean, then the first) in which its p is `least` or more.

    Where runs of several such speakers meet, a frame goes to the greater p, then the first name.
    """
    lost = p.where(F.col("p") >= least).join(labels.select("recording_id", "speaker_id").distinct(), ["recording_id", "speaker_id"], "left_anti")
    run = F.col("frame") - F.row_number().over(Window.partitionBy("recording_id", "speaker_id").orderBy("frame"))
    runs = lost.withColumn("run", run)
    best = runs.groupBy("recording_id", "speaker_id", "run").agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("mean"), F.min("frame").alias("a"))
    best = best.groupBy("recording_id", "speaker_id").agg(F.min(F.struct(-F.col("n"), -F.col("mean"), "a", "run")).alias("b")).select("recording_id", "speaker_id", F.col("b.run").alias("run"))
    own = runs.join(best, ["recording_id", "speaker_id", "run"]).groupBy("recording_id", "frame").agg(F.min(F.struct(-F.col("p"), F.col("speaker_id"))).alias("b")).select("recording_id", "frame", F.col("b.speaker_id").alias("back"))
    return labels.join(own, ["recording_id", "frame"], "left").select("recording_id", "frame", F.coalesce("back", "speaker_id").alias("speaker_id"), F.col("back").isNotNull().alias("restored"))
