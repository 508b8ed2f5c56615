"""Text expressions: normal forms, tokens, edit measures, scripts, literals. Built-in functions only, but for NFKC."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = Column | str

#: Unicode scripts that a profile counts, with their Java class.
SCRIPTS = {"latin": r"\p{IsLatin}", "han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "hangul": r"\p{IsHangul}", "cyrillic": r"\p{IsCyrillic}", "arabic": r"\p{IsArabic}", "digit": r"\p{Nd}"}
#: Letters that mark a language.
MARKS = {"de": "[äöüßÄÖÜ]", "fr": "[àâçèéêëîïôùûœÀÂÇÈÉÊËÎÏÔÙÛŒ]", "es": "[ñáíóú¿¡ÑÁÍÓÚ]"}
CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯]"
#: Literals that must survive an edit, by kind.
LITERALS = {"url": r"https?://[^\s]+", "email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+", "version": r"\b[0-9]+\.[0-9]+\.[0-9]+\b", "number": r"\b[0-9]+\b", "acronym": r"\b[A-Z]{2,6}\b"}

#: The scripts in which a language is written.
WRITTEN_IN = {
    **dict.fromkeys("af ca cs cy da de en es et fi fr ga hr hu id is it la lt lv ms nl no pl pt ro sk sl sq sv sw tr vi".split(), ("latin",)),
    "zh": ("han",), "ja": ("han", "kana"), "ko": ("hangul",), **dict.fromkeys("ru uk be bg mk sr".split(), ("cyrillic",)), **dict.fromkeys("ar fa ur ps".split(), ("arabic",)),
}


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form and case folding, which Spark SQL has not; one Arrow batch at a time."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def normalized(text: C, latin_only: bool = True) -> Column:
    """Lower case, letters and digits and single spaces. latin_only: built-in functions; else by NFKC and case folding."""
    base = F.lower(col(text)) if latin_only else nfkc(col(text))
    return F.trim(F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def score_tokens(text: C) -> Column:
    """Characters if the text has any CJK letter, else words."""
    t = col(text)
    return F.when(t.rlike(CJK), F.filter(F.split(F.regexp_replace(t, r"\s", ""), ""), lambda x: x != "")).otherwise(F.filter(F.split(t, r"\s+"), lambda x: x != ""))


def _letter(k: Column) -> Column:
    code = k.cast("long") + F.lit(0x3400)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(code < 0xD800, code).otherwise(code + 0x800)), 8, "0")), "UTF-32")


def token_distance(words: C, others: C) -> Column:
    """Edit distance in words."""
    return word_distance(col(words), col(others))


#: Items beyond which edit_steps keeps to a band of the table, the columns for which that stands still, and the share of steps it first allows for.
WHOLE, STRIDE, SHARE = 1_200, 256, 0.22


def bit_rows(items: Sequence) -> dict:
    """Each different item with a whole number that has its places' bits; with the list of its places where those are few, so that many different items do not take a whole number each."""
    places: dict = {}
    for k, c in enumerate(items):
        places.setdefault(c, []).append(k)
    for c, own in places.items():
        if len(own) > 8:
            bits = bytearray((len(items) >> 3) + 1)
            for k in own:
                bits[k >> 3] |= 1 << (k & 7)
            places[c] = int.from_bytes(bits, "little")
    return places


def edit_steps(a: Sequence, b: Sequence) -> int:
    """Edit distance in items (the characters of two texts, the words of two lists): a column of the table is two whole numbers with one bit a row (Myers, Hyyrö).

    Long ones first look in a band around the diagonal: what that gives is the cost of some way, and the distance if no cheaper way leaves the band; else a band of that cost is wide enough.
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    most = max(int(SHARE * len(a)), len(a) - len(b)) if len(a) > WHOLE else len(a)
    while True:
        n = _steps_within(a, b, most)
        if n <= most:
            return n
        most = n


def _steps_within(a: Sequence, b: Sequence, most: int) -> int:
    """Least cost of the ways from a to b (not longer than a) within the band that holds all those of `most` steps."""
    where = bit_rows(a)
    below, above = (most - len(a) + len(b)) // 2, (most + len(a) - len(b)) // 2  # rows before and after the diagonal that the band holds
    stride = STRIDE if below + above + STRIDE < len(a) else len(b)
    low, high, n, up, down = 0, 0, 0, 0, 0  # rows low to high; n: the cost at row low
    for first in range(0, len(b), stride):
        last = min(first + stride, len(b))
        left = max(0, first - below) - low
        if left:
            gone = (1 << left) - 1
            n += (up & gone).bit_count() - (down & gone).bit_count()
            up, down, low = up >> left, down >> left, low + left
        more = min(len(a), last + above)
        up |= ((1 << more - high) - 1) << high - low
        high = more
        full, masks = (1 << high - low) - 1, {}
        for c in b[first:last]:
            same = masks.get(c)
            if same is None:
                rows = where.get(c, ())
                same = sum(1 << k - low for k in rows if low <= k < high) if type(rows) is not int else masks.setdefault(c, rows >> low & full)
            flat = (((same & up) + up) ^ up) | same | down
            across = (down | (full ^ (flat | up))) << 1 | 1
            up, down = ((flat & up) << 1 | (full ^ (flat | across))) & full, across & flat
        down &= full
        n += last - first
    return n + up.bit_count() - down.bit_count()


@F.pandas_udf(T.LongType())
def edit_distance(text: pd.Series, other: pd.Series) -> pd.Series:
    """edit_steps by Arrow batches; levenshtein of Spark SQL visits every cell, too slow for long texts."""
    return pd.Series([None if a is None or b is None else edit_steps(a, b) for a, b in zip(text, other, strict=True)], dtype="Int64")


@F.pandas_udf(T.IntegerType())
def word_distance(words: pd.Series, others: pd.Series) -> pd.Series:
    """edit_steps of two lists of words by Arrow batches."""
    return pd.Series([None if a is None or b is None else edit_steps(list(a), list(b)) for a, b in zip(words, others, strict=True)], dtype="Int32")


def error_rate(distance: C, size: C) -> Column:
    return F.when(col(size) > 0, F.round(col(distance) / col(size), 9))


def script_counts(text: C) -> list[Column]:
    return [F.regexp_count(col(text), F.lit(p)).cast("long").alias(k) for k, p in SCRIPTS.items()]


def language_by_marks(text: C, least: float = 0.002) -> Column:
    """The language whose mark letters are most frequent, `en` for a Latin text without marks, `und` else."""
    t = col(text)
    latin = F.regexp_count(t, F.lit(r"\p{IsLatin}"))
    counts = {k: F.regexp_count(t, F.lit(p)) for k, p in MARKS.items()}
    most = F.greatest(*counts.values())
    out = F.when(latin < F.length(t) * 0.5, "und").when(most < latin * least, "en")
    for k, n in counts.items():
        out = out.when(n == most, k)
    return out.otherwise("und")


def literals(text: C, kind: str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(LITERALS[kind]), F.lit(0))


def protected_kept(source: C, output: C) -> Column:
    """Whether the multiset of acronyms and numbers is the same."""
    own = lambda t: F.array_sort(F.concat(literals(t, "acronym"), literals(t, "number")))
    return own(source) == own(output)


def untranslated(source: C, output: C, source_language: C, target_language: C, latin_only: bool = True) -> Column:
    """Whether output, given as a translation, still is in the source's language: true only where that is plain.

    It is so if the source has letters and the output none; if both have the same letters and digits, case aside, and the source six letters (three, if it has no literals);
    or if the source's main script (8 letters or more, more than it has of the target's) still rules the output: 8 letters, four times those of the target's scripts, and
    fewer of those than 2 or a sixth. Equal primary languages are never untranslated; a target whose script is not known is so by the first rules alone. Nulls count as empty.
    """
    s, o = F.coalesce(col(source), F.lit("")), F.coalesce(col(output), F.lit(""))
    root = lambda x: F.lower(F.split(F.coalesce(col(x), F.lit("")), "-")[0])
    scripts = [k for k in SCRIPTS if k != "digit"]
    plain = lambda t: F.regexp_replace(F.lower(t) if latin_only else nfkc(t), r"[^\p{L}\p{N}]", "")
    counted = lambda t: F.struct(*[F.regexp_count(t, F.lit(SCRIPTS[k])).alias(k) for k in scripts], F.regexp_count(t, F.lit(r"\p{L}")).alias("letters"))
    literal = F.lit(False)
    for pattern in LITERALS.values():
        literal = literal | s.rlike(pattern)
    known = F.struct(counted(s).alias("s"), counted(o).alias("o"), (plain(s) == plain(o)).alias("same"), literal.alias("literal"), root(target_language).alias("target"))

    def verdict(x: Column) -> Column:
        other = lambda c: F.greatest(F.lit(0), c.letters - sum(c[k] for k in scripts))
        of_target = lambda c: F.coalesce(*[F.when(x.target.isin([k for k, v in WRITTEN_IN.items() if v == kind]), sum(c[k] for k in kind)) for kind in sorted(set(WRITTEN_IN.values()))])
        most = F.greatest(*[x.s[k] for k in scripts], other(x.s))
        left = F.coalesce(*[F.when(x.s[k] == most, x.o[k]) for k in scripts], other(x.o))  # the first of equal scripts
        asked = of_target(x.o)
        ruled = (most >= 8) & (of_target(x.s) < most) & (left >= 8) & (left >= asked * 4) & (asked < F.greatest(F.lit(2), F.floor(left / 6)))
        return ((x.s.letters >= 1) & (x.o.letters == 0)) | (x.same & ((x.s.letters >= 6) | ((x.s.letters >= 3) & ~x.literal))) | F.coalesce(ruled, F.lit(False))

    found = F.transform(F.array(known), verdict)[0]  # the counts once, then the rules
    return F.when(root(source_language) == root(target_language), False).otherwise(found)


def suffix_prefix(left: C, right: C, least: int = 5, most: int = 120) -> Column:
    """The longest suffix of left that right begins with, in characters; 0 below `least`."""
    l, r = col(left), col(right)
    top = F.least(F.lit(most), F.length(l), F.length(r))
    sizes = F.when(top >= least, F.sequence(F.lit(least), F.greatest(top, F.lit(least)))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(sizes, lambda n: F.right(l, n) == F.left(r, n))), F.lit(0))


def clock(ms: C, mark: str = ",") -> Column:
    m = col(ms)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(m / 3_600_000), F.floor(m / 60_000) % 60, F.floor(m / 1000) % 60, m % 1000)


def iso_duration(ms: C) -> Column:
    m = col(ms)
    return F.format_string("PT%dH%dM%d.%03dS", F.floor(m / 3_600_000), F.floor(m / 60_000) % 60, F.floor(m / 1000) % 60, m % 1000)


def display_width(text: C) -> Column:
    """Wide letters count 2, marks 0.5, others 1."""
    t = col(text)
    wide = F.regexp_count(t, F.lit(CJK))
    thin = F.regexp_count(t, F.lit(r"[.,:;'!|]"))
    return F.round(F.length(t) + wide - thin * 0.5, 1)


def reading_units(text: C) -> Column:
    return F.length(F.regexp_replace(col(text), r"\s", ""))


def punctuation_only_change(source: C, output: C) -> Column:
    bare = lambda t: F.regexp_replace(col(t), r"[\p{P}\p{S}\s]", "")
    return (col(source) != col(output)) & (bare(source) == bare(output))


def normalize_speaker(raw: C) -> Column:
    """The last run of digits as a number, else the label, `0` for none."""
    t = F.trim(F.coalesce(col(raw), F.lit("")))
    digits = F.regexp_extract(t, r"(\d+)\D*$", 1)
    return F.when(digits != "", digits.cast("long").cast("string")).when(t != "", t).otherwise("0")


def language_tag(tag: C) -> Column:
    """Canonical case of a language tag: language lower, script title, region upper; null if it is not one."""
    parts = F.split(F.lower(F.regexp_replace(F.trim(col(tag)), "_", "-")), "-")
    cased = F.transform(parts, lambda p, i: F.when(i == 0, p).when(F.length(p) == 4, F.initcap(p)).when(F.length(p) == 2, F.upper(p)).otherwise(p))
    out = F.array_join(cased, "-")
    return F.when(out.rlike(r"^[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|[0-9]{3}))?(-[a-z0-9]{5,8})*$"), out)


def languages_agree(left: C, right: C) -> Column:
    """Same primary language, zh and cmn being one; `und` and `mul` agree with all."""
    primary = lambda t: F.regexp_replace(F.lower(F.substring_index(col(t), "-", 1)), "^cmn$", "zh")
    open_ = lambda t: primary(t).isin("und", "mul")
    return open_(left) | open_(right) | (primary(left) == primary(right))


def human_size(n: C) -> Column:
    v = col(n).cast("double")
    return F.when(v < 1024, F.format_string("%d B", col(n).cast("long"))).when(v < 1024**2, F.format_string("%.1f KB", F.bround(v / 1024, 1))).when(v < 1024**3, F.format_string("%.1f MB", F.bround(v / 1024**2, 1))).otherwise(F.format_string("%.1f GB", F.bround(v / 1024**3, 1)))
