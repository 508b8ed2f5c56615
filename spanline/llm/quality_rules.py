"""Quality rules with adaptive thresholds: quantile sketches per language and source replace fixed cutoffs.

Counts of every text come from SQL functions over the whole text. Each measure is rounded to a whole bin of 0 to 1000; the number
of rows in each (language, source, measure, bin) is a quantile sketch whose merge is plain addition, so it is exact to a
bin, the same at any partitioning, and no task needs the rows of a source together. Sketches of a language and of all rows are sums of those of sources.

A threshold is where a sketch shows a mode of its own above the others: of all cuts between the sketch's median and its
0.99 quantile the one that leaves least variance on both sides (Otsu), if its two sides are as far apart as APART says
(Ashman's D, in units of their spread, which no scale of a measure changes), half way over the empty bins. Below the first cut a second one counts if it is twice
as far apart, as junk may have two modes. Sources lean on their language and languages on all rows, the more the fewer rows they
have; one without an upper mode takes the threshold above it, and where there is none the measure fails nothing.
Texts with a measure above its threshold fail. Only DataFrame functions are used.

Defined cases: a null or empty text has no words and fails the base rule; a null language or source is a group of its
own; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dropped, small

SPACE = r"[ \\t\\n\\x0B\\f\\r]"

#: name: measure in whole bins of 0 to 1000, as SQL over the counts.
MEASURES = {
    "symbols": "1000 * n_symbols / greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines / greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words / greatest(n_words, 1)",
    "shouts": "least(1000, 1000 * n_shouts / greatest(n_words, 1))",
}
#: Least separation of an upper mode; percent of a sketch's rows it must hold at least; quantile, in thousandths, beyond which values
#: count as the quantile; rows as which the thresholds above a group count.
APART, LEAST_TAIL, UPPER, PRIOR = 3.0, 1, 995, 500


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text. Nested transforms over one-element arrays bind a value once."""
    def same(other: str) -> str:
        return f"x.h = {other}.h AND w[x.i] = w[{other}.i] AND w[x.i + 1] = w[{other}.i + 1] AND w[x.i + 2] = w[{other}.i + 2]"

    counts = f"""transform(array(filter(split(t, '{SPACE}+'), x -> x != '')), w -> struct(
        bigint(size(w)) AS n_words,
        aggregate(w, 0L, (a, x) -> a + char_length(x)) AS word_chars,
        if(size(w) < 4, 0L, transform(array(sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i)))), s ->
            aggregate(
                sort_array(transform(filter(s, (x, j) -> (j > 0 AND {same('s[j - 1]')}) OR (j + 1 < size(s) AND {same('s[j + 1]')})), x -> x.i)),
                struct(0L AS n, -3 AS last),
                (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last),
                a -> a.n))[0]) AS n_repeat_words))[0]"""
    lines = f"transform(array(filter(split(t, '\\n'), l -> l rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]')), l -> struct(bigint(size(l)) AS n_lines, bigint(size(l) - size(array_distinct(l))) AS n_dup_lines))[0]"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    found = texts.select("doc_id", "lang", "source", F.expr(counts).alias("c"), F.expr(lines).alias("l"), F.expr("bigint(regexp_count(t, '[#*$%&|<>]'))").alias("n_symbols"), F.expr("bigint(regexp_count(t, '[!?]'))").alias("n_shouts"))
    return found.select("doc_id", "lang", "source", "c.n_words", "c.word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words", "l.n_lines", "n_shouts")


GROUP = ["level", "lang", "source"]


def upper_modes(sketch: DataFrame, apart: float) -> DataFrame:
    """level, lang, source, measure and cut: half way between the bins where a sketch's upper mode begins, of sketches that have one."""
    group = Window.partitionBy(*GROUP, "measure")
    up = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    own = sketch.select(*GROUP, "measure", "bin", "n", F.lead("bin").over(group.orderBy("bin")).alias("next"), F.sum("n").over(up).alias("rows"), F.sum("n").over(group).alias("all_rows"))
    # what lies beyond the upper quantile counts as that, so that a few extremes don't hide a mode
    own = own.withColumn("value", F.least("bin", F.min(F.when(1000 * F.col("rows") >= UPPER * F.col("all_rows"), F.col("bin"))).over(group)))
    sums = {"first": F.col("n") * F.col("value"), "second": F.col("n") * F.col("value") * F.col("value")}
    own = own.select("*", *[F.sum(x).over(up).alias(k) for k, x in sums.items()], *[F.sum(x).over(group).alias(f"all_{k}") for k, x in sums.items()])
    own = own.where("next IS NOT NULL").withColumn("tail", F.col("all_rows") - F.col("rows")).where((100 * F.col("tail") >= LEAST_TAIL * F.col("all_rows")) & (2 * F.col("tail") <= F.col("all_rows")))
    low, high = F.col("first") / F.col("rows"), (F.col("all_first") - F.col("first")) / F.col("tail")
    spread = F.col("second") / F.col("rows") - low * low + (F.col("all_second") - F.col("second")) / F.col("tail") - high * high
    way = F.struct((F.col("rows") * F.col("tail") * (high - low) * (high - low)).alias("between"), (-F.col("bin")).alias("least"), F.floor((F.col("bin") + F.col("next")) / 2).alias("cut"), (2 * (high - low) * (high - low) >= apart * apart * spread).alias("apart"))
    return own.groupBy(*GROUP, "measure").agg(F.max(way).alias("way")).where("way.apart").select(*GROUP, "measure", "way.cut")


def thresholds(counts: DataFrame) -> DataFrame:
    """lang, source and, for each measure, the highest value that passes (null: all pass)."""
    bins = counts.select("lang", "source", F.expr("stack({}, {}) AS (measure, bin)".format(len(MEASURES), ", ".join(f"'{k}', bigint({x})" for k, x in MEASURES.items()))))
    by_source = cut(bins.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n")))
    none = F.lit(None).cast("string")
    levels = [by_source.select(F.lit(0).alias("level"), "lang", "source", "measure", "bin", "n")]
    levels += [by_source.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n")).select(F.lit(k + 1).alias("level"), *[F.col(c) if c in keys else none.alias(c) for c in ("lang", "source")], "measure", "bin", "n") for k, keys in enumerate((["lang"], []))]
    sketch = cut(levels[0].unionByName(levels[1]).unionByName(levels[2]))
    first = cut(upper_modes(sketch, APART))
    rest = sketch.alias("s").join(first.alias("f"), [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in (*GROUP, "measure")]).where("s.bin <= f.cut").select("s.*")
    both = first.unionByName(cut(upper_modes(rest, 2 * APART))).groupBy(*GROUP, "measure").agg(F.min("cut").alias("cut"))
    wide = both.groupBy(*GROUP).agg(*[F.max(F.when(F.col("measure") == k, F.col("cut"))).alias(f"own_{k}") for k in MEASURES])
    sizes = sketch.where(F.col("measure") == next(iter(MEASURES))).groupBy(*GROUP).agg(F.sum("n").alias("rows"))
    found = cut(sizes.alias("s").join(wide.alias("w"), [F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}")) for k in GROUP], "left").select("s.*", *[f"own_{k}" for k in MEASURES]))

    def leaning(own: str, above: str):
        return F.when(F.col(own).isNull(), F.col(above)).when(F.col(above).isNull(), F.col(own)).otherwise((F.col("rows") * F.col(own) + PRIOR * F.col(above)) / (F.col("rows") + PRIOR))

    top = found.where("level = 2").first()  # one row of constants; none for an empty table
    above = found.where("level = 1")
    for k in MEASURES:
        above = above.withColumn(f"all_{k}", F.lit(top[f"own_{k}"] if top else None).cast("double"))
    langs = above.select(F.col("lang").alias("__lang"), *[leaning(f"own_{k}", f"all_{k}").alias(f"lang_{k}") for k in MEASURES])
    sources = found.where("level = 0").join(langs, F.col("lang").eqNullSafe(F.col("__lang")))
    dropped(by_source, first)
    return sources.select("lang", "source", *[F.floor(leaning(f"own_{k}", f"lang_{k}")).cast("long").alias(f"top_{k}") for k in MEASURES])


def judge(docs: DataFrame, broadcast_rows: int = 20_000) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row; the thresholds are broadcast up to `broadcast_rows` groups, else joined by shuffle."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = cut(text_counts(docs))
    tops = cut(thresholds(counts))
    own = tops.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[f"top_{k}" for k in MEASURES])
    joined = counts.join(F.broadcast(own) if small(tops, broadcast_rows) else own, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    passed = F.lit(True)
    for k, measure in MEASURES.items():
        passed = passed & (F.col(f"top_{k}").isNull() | (F.expr(f"bigint({measure})") <= F.col(f"top_{k}")))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passed).alias("kept"))
