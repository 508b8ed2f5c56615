"""Queries over all texts, long, other-language and non-ASCII ones among them, against brute force."""

import random
import re
import unicodedata
from collections import Counter

import pytest

from spanline.operators import evidence as E
from spanline.plans.catalog import QUERIES


def edited(words):
    return [x for k, w in enumerate(words, 1) if k % 7 for x in [w] * (1 + (k % 11 == 0))]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: rng.choice(["über", "naïve", "der", "USA", "42", "año", "x.y@z.org", "https://a.b/c"])
    own = [(0, "plain words only", "en"), (1, " ".join(word() for _ in range(600)), "de"), (2, "a b c d e f g h i j k l", "fr"), (3, " ".join(["été"] * 30), "fr"), (4, "one\ntwo " * 290, "en"), (5, "", "en")]
    where = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(k, t, lang, "s", len(t)) for k, t, lang in own], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    assert max(len(t) for _, t, _ in own) > 2000
    return where, {k: (lang, (w := t.replace("\n", " ").split(" ")), edited(w), t) for k, t, lang in own}


def rows(spark, name, where):
    return {r.doc_id: r for r in QUERIES[name](spark, where).collect()}


def test_edit_queries_cover_all_texts(spark, texts):
    where, own = texts
    near = lambda x, n, d: (x is None and not d) or abs(x - n / d) < 1e-8
    got = {n: rows(spark, n, where) for n in ("h3_edit_distance", "h4_error_rate", "h5_normalized_distance", "h3_token_distance", "d36_edit_counts", "h7_protected_tokens", "h12_copied_source", "h20_edit_spans", "h6_letter_retention")}
    assert all(set(g) == set(own) for n, g in got.items() if n != "h6_letter_retention")
    assert set(got["h6_letter_retention"]) == {1, 3}
    protected = lambda t: Counter(re.findall(r"\b[A-Z]{2,6}\b|\b[0-9]+\b", t, re.ASCII))
    norm = lambda t: re.sub(r"\s+", " ", "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t.lower())).strip()
    for k, (_, a, b, _) in own.items():
        x, y = " ".join(a), " ".join(b)
        d = distance(x, y)
        assert got["h3_edit_distance"][k].distance == d
        assert near(got["h4_error_rate"][k].cer, d, len(x)) and got["h4_error_rate"][k].label == ("worsened" if d else "tied")
        assert near(got["h5_normalized_distance"][k].distance, d, max(len(x), len(y)))
        c = got["d36_edit_counts"][k]
        assert got["h3_token_distance"][k].distance == distance(a, b) == c.substituted + c.inserted + c.deleted and c.inserted - c.deleted == len(b) - len(a)
        assert got["h7_protected_tokens"][k].kept == (protected(x) == protected(y))
        assert got["h12_copied_source"][k].copied == (norm(x) == norm(y))
        truth, found = {i for i in range(1, len(a) + 1) if i % 7 == 0 or i % 11 == 0}, {i for i in range(1, min(len(a), len(b)) + 1) if a[i - 1] != b[i - 1]}
        r = got["h20_edit_spans"][k]
        assert r.hits == len(truth & found) and near(r.precision, r.hits, len(found)) and near(r.recall, r.hits, len(truth))
        if k in (1, 3):
            p, q = Counter(ch for ch in x if ch > "~"), Counter(ch for ch in y if ch > "~")
            assert near(got["h6_letter_retention"][k].retention, sum((p & q).values()), sum(p.values()))


def test_counts_over_all_texts(spark, texts):
    where, own = texts
    want = Counter()
    for lang, a, b, _ in own.values():
        want[lang, "equal"] += sum(x == y for x, y in zip(a, b))
        want[lang, "words"] += len(a)
    got = QUERIES["d23_token_agreement"](spark, where).collect()
    assert {r.lang: (r.n_equal, r.n_words) for r in got} == {lang: (want[lang, "equal"], want[lang, "words"]) for lang in ("en", "de", "fr")}
    inventory = {(r.kind, r.literal): r.n for r in QUERIES["h8_literal_inventory"](spark, where).collect()}
    words = Counter(own[1][1])
    assert inventory == {("acronym", "USA"): words["USA"], ("email", "x.y@z.org"): words["x.y@z.org"], ("url", "https://a.b/c"): words["https://a.b/c"]}


def test_edit_counts_with_kept_rows_equal_the_full_table():
    def full(a, b):
        t = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        i, j, s, n, d = len(a), len(b), 0, 0, 0
        while i or j:
            if i and j and t[i][j] == t[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                s, i, j = s + (a[i - 1] != b[j - 1]), i - 1, j - 1
            elif i and t[i][j] == t[i - 1][j] + 1:
                d, i = d + 1, i - 1
            else:
                n, j = n + 1, j - 1
        return s, n, d

    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert E.edit_counts(a, b) == full(a, b)


def test_token_distance_of_many_distinct_words(spark):
    from spanline.functions import text as X

    df = spark.range(1).selectExpr("transform(sequence(1, 45000), x -> string(x)) AS a").selectExpr("slice(a, 44990, 11) AS a", "slice(a, 44989, 11) AS b", "a AS every")
    letters = df.select(X._letter(X.F.lit(41_985)).alias("x"), X._letter(X.F.lit(60_000)).alias("y"), X.token_distance("a", "b").alias("d")).first()
    assert (ord(letters.x), ord(letters.y)) == (41_985 + 0x3400 + 0x800, 60_000 + 0x3400 + 0x800) and letters.d == 2
