"""Review tables: queues, decisions, speaker edits, final transcripts, cues and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import by_group


def review_queue(segments: DataFrame, low: float = 0.3, long_ms: int = 60_000) -> DataFrame:
    """A row for each segment and reason, and one for each recording whose mean confidence is low."""
    d = F.col("end_ms") - F.col("start_ms")
    reasons = F.array_compact(F.array(F.when(F.col("confidence") < low, "LOW_CONFIDENCE"), F.when(d > long_ms, "LONG_SEGMENT"), F.when(F.length("text") < 20, "SHORT_TEXT")))
    own = segments.select("recording_id", "segment_id", F.explode(reasons).alias("reason"))
    job = segments.groupBy("recording_id").agg(F.avg("confidence").alias("c")).where(F.col("c") < 0.5).select("recording_id", F.lit("*").alias("segment_id"), F.lit("LOW_MEAN_CONFIDENCE").alias("reason"))
    return own.unionByName(job)


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each segment by sequence; a segment's repeated decision id counts once. Ids need not differ between segments."""
    first = decisions.groupBy("segment_id", "decision_id").agg(F.min(F.struct("seq", "action", "text")).alias("d")).select("segment_id", "decision_id", "d.*")
    return first.groupBy("segment_id").agg(F.max_by(F.struct("action", "text"), F.struct("seq", "decision_id")).alias("d"), F.count("*").alias("n")).select("segment_id", "d.action", "d.text", "n")


def apply_decisions(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """segments with the text shown after the last decision; the raw text stays. An edit needs a text, a reject shows none."""
    last = latest_decisions(decisions).select("segment_id", F.col("action").alias("__a"), F.col("text").alias("__t"), F.col("n").alias("__n"))
    out = segments.join(last, "segment_id", "left")
    shown = F.when(F.col("__a") == "edit", F.coalesce("__t", "text")).when(F.col("__a") == "reject", F.lit(None)).otherwise(F.col("text"))
    return out.select(*segments.columns, shown.alias("display_text"), F.coalesce("__a", F.lit("none")).alias("action"), F.coalesce("__n", F.lit(0)).alias("n_revisions"))


def merge_speakers(segments: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Speakers renamed or merged by a small map, then numbered speaker-1.. by first appearance in their recording."""
    to = F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col("speaker_id")], F.col("speaker_id"))
    named = segments.withColumn("__s", to)
    first = F.min("start_ms").over(Window.partitionBy("recording_id", "__s"))
    number = F.dense_rank().over(Window.partitionBy("recording_id").orderBy("__first", "__s"))
    return named.withColumn("__first", first).withColumn("speaker", F.concat(F.lit("speaker-"), number.cast("string"))).drop("__s", "__first")


def resolution(queue: DataFrame) -> DataFrame:
    """Open and resolved items of each segment, and whether all are resolved (column status)."""
    return queue.groupBy("segment_id").agg(F.count_if(F.col("status") == "open").alias("n_open"), F.count_if(F.col("status") != "open").alias("n_resolved"), F.bool_and(F.col("status") != "open").alias("complete"))


def final_text(segments: DataFrame, manual: DataFrame, composed: DataFrame) -> DataFrame:
    """The text by priority: manual, composed, raw; with its source."""
    m, c = manual.select("segment_id", F.col("text").alias("__m")), composed.select("segment_id", F.col("text").alias("__c"))
    out = segments.join(m, "segment_id", "left").join(c, "segment_id", "left")
    source = F.when(F.col("__m").isNotNull(), "manual").when(F.col("__c").isNotNull(), "composed").otherwise("raw")
    return out.select("segment_id", F.coalesce("__m", "__c", "text").alias("text"), source.alias("source"))


def preferences(reviews: DataFrame) -> DataFrame:
    """By model: severity counts, fractional credit for being preferred (shared in a case), and rank with ties."""
    share = reviews.where("preferred").withColumn("credit", 1 / F.count("*").over(Window.partitionBy("case_id"))).groupBy("alias").agg(F.sum("credit").alias("credit"))
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    per = reviews.groupBy("alias").agg(n("critical"), n("major"), n("minor")).join(share, "alias", "left").withColumn("credit", F.round(F.coalesce("credit", F.lit(0.0)), 9))
    return per.withColumn("rank", F.rank().over(Window.orderBy("n_critical", "n_major", "n_minor", F.desc("credit"))).cast("long"))


def cues(segments: DataFrame, most: int = 84) -> DataFrame:
    """Texts cut into pieces of at most `most` characters at spaces or marks where there are any; time shared by length; numbered by recording. The pieces join back to the text."""
    piece = rf"(?s)(.{{1,{most}}}(?:[\s.,;:!?]|$)|.{{1,{most}}})"
    one = segments.select("recording_id", "turn", "start_ms", "end_ms", F.length("text").alias("n"), F.posexplode(F.regexp_extract_all("text", F.lit(piece), F.lit(1))).alias("part", "text"))
    w = Window.partitionBy("recording_id", "turn").orderBy("part")
    upto = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = F.col("end_ms") - F.col("start_ms")
    timed = one.withColumn("__to", upto).withColumn("__s", F.col("start_ms") + F.floor(d * (F.col("__to") - F.length("text")) / F.col("n"))).withColumn("__e", F.col("start_ms") + F.floor(d * F.col("__to") / F.col("n")))
    number = F.row_number().over(Window.partitionBy("recording_id").orderBy("turn", "part"))
    return timed.select("recording_id", number.cast("long").alias("number"), F.col("__s").cast("long").alias("start_ms"), F.col("__e").cast("long").alias("end_ms"), "text")


def bounded_batches(segments: DataFrame, most_items: int, most_chars: int) -> DataFrame:
    """Batches in order, with at most so many items and characters; a row is never split."""

    def fill(rows):
        batch, items, chars = -1, most_items, 0
        for _, segment, n in rows:
            if items >= most_items or chars + n > most_chars:
                batch, items, chars = batch + 1, 0, 0
            items, chars = items + 1, chars + n
            yield segment, batch, items, chars

    sized = segments.withColumn("n", F.length("text").cast("long"))
    return by_group(sized, ["recording_id"], ["start_ms", "segment_id", "n"], fill, "segment_id string, batch long, items long, chars long")


def text_chunks(docs: DataFrame, target: int, overlap: int = 0) -> DataFrame:
    """Lines of a text gathered into chunks of about `target` characters, cut at line ends; each line has its chunk. The last lines of a chunk, up to `overlap` characters with their line ends, come again before the next chunk (repeated)."""
    lines = docs.select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), F.length)).alias("line", "n"))  # lengths alone are shuffled
    size = F.col("n") + 1
    before = F.sum(size).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) - size
    own = lines.select("doc_id", "line", F.floor(before / target).alias("chunk"), "n")
    if not overlap:
        return own.withColumn("repeated", F.lit(False))
    to_end = F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id", "chunk").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0))
    chunks = own.groupBy("doc_id", "chunk").agg(F.count("*").alias("lines")).select("doc_id", "chunk", F.lead("chunk").over(Window.partitionBy("doc_id").orderBy("chunk")).alias("next")).where("next IS NOT NULL")
    again = own.withColumn("to_end", to_end).where(F.col("to_end") <= overlap).join(chunks, ["doc_id", "chunk"])
    return own.withColumn("repeated", F.lit(False)).unionByName(again.select("doc_id", "line", F.col("next").alias("chunk"), "n", F.lit(True).alias("repeated")))


def completeness(segments: DataFrame, done: DataFrame) -> DataFrame:
    """Share of a recording's segments that have a translation, and how many lack one."""
    have = done.select("segment_id").distinct().withColumn("__has", F.lit(True))
    return segments.join(have, "segment_id", "left").groupBy("recording_id").agg(F.count("*").alias("n"), F.count_if(F.col("__has").isNull()).alias("n_missing"), F.round(F.avg(F.when(F.col("__has"), 1).otherwise(0)), 9).alias("share"))


def new_items(queue: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The queue and those items whose id it has not."""
    return queue.unionByName(items.join(queue.select(key), key, "left_anti").select(*queue.columns))


def srt(cues: DataFrame) -> Column:
    """One subtitle block of a cue row."""
    from spanline.functions.text import clock

    return F.concat(F.col("number").cast("string"), F.lit("\n"), clock("start_ms"), F.lit(" --> "), clock("end_ms"), F.lit("\n"), F.trim("text"), F.lit("\n"))
