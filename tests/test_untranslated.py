"""Which outputs still are in the source's language."""

from spanline.functions import text as X

CASES = [
    ("Guten Morgen", "GUTEN  morgen!", "de", "en", True),
    ("Guten Morgen", "GUTEN  morgen!", "de", "de-AT", False),  # equal primary languages
    ("abc", "abc", "en", "fr", True),
    ("abc 12", "abc 12", "en", "fr", False),  # a literal and few letters
    ("hello", "123", "en", "fr", True),
    ("", "", "en", "fr", False),
    (None, None, None, "fr", False),
    ("plain words here", "other latin words", "en", "ru", True),
    ("plain words here", "простые слова здесь", "en", "ru", False),
    ("plain words here", "other latin words", "en", "de", False),  # the target is written in the same script
    ("plain words here", "other latin words", "en", "xx", False),  # script not known
    ("plain words", "слова и слова API", "en", "ru", False),
    ("привет всем людям", "привет всем снова", "ru", "ja", True),
    ("привет всем людям", "こんにちは привет всем снова", "ru", "zh", True),
    ("שלום לכם חברים", "שלום לכם אנשים", "he", "en", True),  # a script without a count of its own
]


def test_untranslated(spark):
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(CASES)], "k int, s string, o string, a string, b string")
    got = {r.k: r.u for r in df.select("k", X.untranslated("s", "o", "a", "b").alias("u")).collect()}
    assert got == {k: c[4] for k, c in enumerate(CASES)}
    assert got == {r.k: r.u for r in df.select("k", X.untranslated("s", "o", "a", "b", latin_only=False).alias("u")).collect()}
