"""The operators on single texts against libraries and brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanline.llm import bpe, decontaminate, licenses, quality_model, quality_rules, secret_scan, shards, token_counts
from spanline.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEé中ü '.,!?\n\t0123456789-_"
    out = [None, "", " ", "\n\n", "a", "don't we'll 'tis ''s", "<|endoftext|>", "x<|endoftext|>  <|endoftext|>y <|endof", "中文字" * 200, "a" * 3000, "=" * 1500, "ab1" * 700, "  \n  x   ", "　wide space", "🙂🙃" * 50, "\x00\x01 nul"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    out += ["".join(rng.choice("thenioas") for _ in range(2500)), " ".join("".join(rng.choice("thenioas'") for _ in range(rng.randint(1, 9))) for _ in range(800))]
    return [*out, out[-1]]


def table(spark, texts, ids=None, extra="n_tokens int, __found string"):
    ids = ids or [None if k == 3 else k // 2 for k in range(len(texts))]
    rows = [(i, t, k, "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(3)


def as_counter(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("part_chars", [97, 32_768])
def test_bpe_equals_the_library(spark, part_chars):
    texts, lib = odd_texts(), library()
    want = Counter()
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want[(None if k == 3 else k // 2, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    df = table(spark, texts)
    assert as_counter(bpe.encode_and_decode(df, PATH, part_chars)) == want
    kept = bpe.encode_texts(df, PATH, part_chars=part_chars)
    assert kept.columns == [*df.columns, "__bpe"] and kept.where("__bpe.decoded <> coalesce(text, '')").count() == 0


def test_bpe_of_long_texts(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("thenioas'é") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    text = " ".join(rng.choices(words, k=200_000))
    texts = [text, text[:70_000] + "<|endoftext|>" + text[70_000:150_000] + "<|endoftext|><|endoftext|>" + "a" * 100_000, text, "<|endoftext|>" * 6_000]
    lib = library()
    want = Counter((k, len(ids := lib.encode(t, add_special_tokens=False).ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(texts))
    assert as_counter(bpe.encode_and_decode(table(spark, texts, list(range(4))), PATH)) == want


def test_bpe_joins_are_exact():
    v = bpe.Vocabulary.load(PATH)
    rng = random.Random(3)
    for _ in range(300):
        whole = bytes(rng.choice(b"thenioas=.x0") for _ in range(rng.randint(2, 60)))
        cut = rng.randint(0, len(whole))
        assert v.join(v.merge(whole[:cut]), v.merge(whole[cut:])) == v.merge(whole)
    for text in odd_texts()[1:]:
        cut = rng.randint(0, len(text))
        if v.special in text:
            continue
        joined = bpe.Part.of(text[:cut], v).join(bpe.Part.of(text[cut:], v), v)
        assert joined.ids == bpe.Part.of(text, v).ids and joined.ends == bpe.Part.of(text, v).ends


def test_token_counts_equal_the_library(spark):
    texts, lib = odd_texts(), library()
    want = Counter((None if k == 3 else k // 2, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for k, t in enumerate(texts))
    assert as_counter(token_counts.count_tokens(table(spark, texts), PATH)) == want
    whole = token_counts.whole_tokens(PATH)
    assert len(whole) > 40_000 and all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(whole), 300))


def test_shards(spark):
    texts = [None, "", "same", "same"] + [f"t{k}" for k in range(1001)]
    df = table(spark, texts)
    got = shards.assign_shards(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((None if k == 3 else k // 2, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in enumerate(texts))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    again = shards.assign_shards(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    ids = sorted((r.slot * 24 + r.shard, r.doc_id or 0) for r in got)
    assert np.corrcoef([i for _, i in ids], range(len(ids)))[0, 1] < 0.15  # shuffled
    for n in (1, 2, 3, 5):
        few = shards.assign_shards(spark.range(n).selectExpr("id AS doc_id", "'x' AS text"), shards=2).collect()
        assert sorted(r.slot * 2 + r.shard for r in few) == list(range(n))


def rule_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark):
    rng = random.Random(7)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 90))) for _ in range(300)]
    texts = [None, "", "few words", "a a a a", "x\x0by\tz\r\nx\x0by\tz", " a b c\n\n a b c\n", "é 中 é 中 é 中", "<|>" + "#" * 90 + " w" * 80] + clean + [c.replace(" ", " % ") for c in clean[:5]]
    rows = [(k, t, "en", None if k % 2 else "s", 0) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int").repartition(4)).collect()}
    for k, t in enumerate(texts):
        r, want = got[k], rule_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert all(got[k].kept for k in range(8, 308)) and not any(got[k].kept for k in range(308, 313))
    assert quality_rules.judge(spark.createDataFrame(rows[:0], "doc_id long, text string, lang string, source string")).count() == 0


def brute_cut(values, apart):
    """Half way over the gap at the best split of whole numbers in two, if its sides are apart."""
    best = None
    n, kinds = len(values), sorted(set(values))
    most = min((v for v in kinds if 1000 * sum(x <= v for x in values) >= 995 * n), default=0)
    for low, high in zip(kinds, kinds[1:]):
        a, b = [min(v, most) for v in values if v <= low], [min(v, most) for v in values if v > low]
        if 100 * len(b) < n or 2 * len(b) > n:
            continue
        way = (len(a) * len(b) * (np.mean(b) - np.mean(a)) ** 2, -low)
        if best is None or way > best[0]:
            best = (way, (low + high) // 2, 2 * (np.mean(b) - np.mean(a)) ** 2 >= apart**2 * (np.var(a) + np.var(b)))
    return best[1] if best and best[2] else None


def brute_top(values):
    cut = brute_cut(values, 3)
    lower = None if cut is None else brute_cut([v for v in values if v <= cut], 6)
    return cut if lower is None else lower


def test_quality_thresholds_equal_brute_force(spark):
    rng = random.Random(17)
    rows = []
    for k in range(4000):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("de", "a"), (None, "c")])
        junk = rng.random() < (0.2 if source == "a" else 0.04 if source == "b" else 0)
        symbols = rng.randint(60, 90) if junk and source == "a" else rng.randint(20, 30) if junk else rng.choice([0, 0, 0, 1, 2])
        rows.append((k, lang, source, 100, 500, symbols, rng.choice([0, 0, 0, 1]), 90 if rng.random() < 0.05 else rng.randint(0, 9), 20, 0))
    counts = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_shouts long").repartition(5)
    measures = {"symbols": lambda r: 1000 * r[5] // r[4], "dup_lines": lambda r: 1000 * r[6] // r[8], "repeats": lambda r: 1000 * r[7] // r[3], "shouts": lambda r: 0}
    got = {(r.lang, r.source): r for r in quality_rules.thresholds(counts).collect()}
    assert set(got) == {(r[1], r[2]) for r in rows}
    lean = lambda own, above, n: above if own is None else own if above is None else (n * own + 500 * above) / (n + 500)
    for k, f in measures.items():
        top = brute_top([f(r) for r in rows])
        for (lang, source), r in got.items():
            of_lang, own = [f(x) for x in rows if x[1] == lang], [f(x) for x in rows if (x[1], x[2]) == (lang, source)]
            want = lean(brute_top(own), lean(brute_top(of_lang), top, len(of_lang)), len(own))
            assert r[f"top_{k}"] == (None if want is None else int(want)), (k, lang, source)
    assert got["en", "a"].top_symbols > got["en", "b"].top_symbols + 10 and got["en", "a"].top_shouts is None
    assert quality_rules.thresholds(counts.limit(0)).count() == 0


def test_secrets(spark):
    rng = random.Random(9)
    key = lambda n, a="abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789": "".join(rng.choice(a) for _ in range(n))
    texts = [None, "", "password=short", "password = token: abcdefgh", "API_KEY: '" + key(20) + "' passwd=\"" + key(9) + "\"", "AKIA AKIAABC AKIA" + key(12, "ABCDEF0123456789"), "x" + key(40, "0123456789abcdef") + "g" + key(31, "0123456789abcdef"), "secret=secret=abcdefghi", "ſecret=abcdefghij tokenK=abcdefghi"]
    texts += [f"some words here {k} token = \"{key(40, '0123456789abcdef')}\" and more words" for k in range(60)] + [f"plain words only {k} in this line" for k in range(60)]
    texts += [f"see password={key(18, '0123456789abcdef')} now" for _ in range(30)] + [f"use {key(4)} and internationalisation-of-words" for _ in range(30)]

    def brute(t):
        t, out = t or "", []
        for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            if len(m[2]) >= 8:
                out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
        out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        return [x[2] for x in sorted(out)]

    df = table(spark, texts, list(range(len(texts))), "spans int, __secrets string")
    got = {r.doc_id: r for r in secret_scan.find_secrets(df).collect()}
    for k, t in enumerate(texts):
        base = brute(t)
        assert got[k].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(sum(x.startswith(n) for x in base) for n in ("assign", "access", "hex"))
        assert set(base) <= set(got[k].spans.split(",")) | {""}
    clean = [r.spans for r in got.values() if "plain words" in (texts[r.doc_id] or "") or "internationalisation" in (texts[r.doc_id] or "")]
    assert not any(clean)
    chain = secret_scan.fit_chain(df)
    hits, alarms = [], []
    for k in range(120):  # secrets that no pattern names, and identifiers beside them
        value = [key(40, "0123456789abcxyz"), key(24) + "+/" + key(18), "ghp_" + key(36), key(20) + "." + key(40) + "." + key(43)][k % 4]
        before = ["some words here with ", 'the value: "', "use bearer "][k % 3]
        spans = [x.split(":") for x in secret_scan.scan(before + value + ' and more words', chain)[4].split(",") if x.startswith("crf")]
        hits.append(any(int(s) < len(before) + len(value) and int(e) > len(before) for _, s, e in spans))
        other = ["chapter_12_section_4", "v2.10.3-beta4", "2023-05-17T10:22:31", "john-smith-1984", "www.words.com/2020/05/17/title"][k % 5]
        alarms.append("crf" in secret_scan.scan(f"some words here with {other} and more words", chain)[4])
    assert np.mean(hits) >= 0.9 and np.mean(alarms) <= 0.1
    again = secret_scan.fit_chain(df.repartition(7))
    assert np.array_equal(chain.tokens, again.tokens) and np.array_equal(chain.moves, again.moves)
    assert secret_scan.fit_chain(df.limit(0)).decode([[1], [2]]) == [0, 0]
    redacted = {r.doc_id: r.text for r in secret_scan.redacted(df).collect()}
    assert redacted[0] is None and redacted[1] == "" and all("[SECRET]" in redacted[k] for k in range(9, 69)) and redacted[70] == texts[70]
    assert secret_scan.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_chain_reads_every_token_of_whole_texts(spark, monkeypatch):
    chain, rng, draw = secret_scan.Chain(), random.Random(3), np.random.default_rng(3)
    chain.tokens = np.round(draw.normal(size=chain.tokens.shape) * secret_scan.FINE) / secret_scan.FINE
    chain.moves = np.round(draw.normal(size=(3, 3)) * secret_scan.FINE) / secret_scan.FINE
    chain.moves[0, 2] = -1e3

    def brute(text):
        run = secret_scan.featured(text, secret_scan.file_features(text))
        if not run:
            return []
        best, steps = chain.moves[0] + chain.scores(run[0][2]), []
        for _, _, features in run[1:]:
            ways = best[:, None] + chain.moves
            steps.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + chain.scores(features)
        tags = [int((best + chain.moves[:, 0]).argmax())]
        for step in reversed(steps):
            tags.insert(0, int(step[tags[0]]))
        out = []
        for (start, end, _), tag in zip(run, tags, strict=True):
            if tag == 1:
                out.append((start, "crf", end))
            elif tag == 2:
                out[-1] = (out[-1][0], "crf", end)
        return [x for x in out if x[2] - x[0] >= 8]

    letters = "aB3 \n_-+/=.!#éßÑ٣𝔸\x1f'\":ſabcdefABC0123456789  "
    texts = ["", " ", "\n\n", "plain words only without any value in them", *["".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 40, 300, 3000]))) for _ in range(60)]]
    want = [brute(text) for text in texts]
    assert want[3] and sum(map(len, want)) > 500
    for size, words in ((secret_scan.PIECE, secret_scan.WORDS), (500, 50), (37, 1)):  # texts together, in pieces, and words forgotten
        monkeypatch.setattr(secret_scan, "PIECE", size)
        monkeypatch.setattr(secret_scan, "WORDS", words)
        assert secret_scan.chain_spans(texts, secret_scan.Reader(chain)) == want

    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    both = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    docs = [f"some words here {k} token = \"{key(40, both + '0123456789')}\" and more words" for k in range(60)]
    docs += [f"plain words only {k} in this line of an internationalisation" for k in range(60)]
    fitted = secret_scan.fit_chain(table(spark, docs))
    for k in range(20):  # no digit or no letter, and no mark before
        value = key(32, both) if k % 2 else key(28, "0123456789")
        assert secret_scan.scan(f"some words here {value} and more words", fitted)[4] == f"crf:16:{16 + len(value)}"
    assert secret_scan.scan("plain words only in this line of an internationalisation", fitted)[4] == ""


def test_viterbi_of_the_chain_is_the_best_path():
    import itertools

    chain, rng = secret_scan.Chain(), np.random.default_rng(1)
    chain.tokens[:50] = rng.normal(size=(50, 3))
    chain.moves += rng.normal(size=(3, 3))
    for _ in range(30):
        run = [rng.integers(0, 50, 4).tolist() for _ in range(rng.integers(1, 6))]

        def score(p, run=run):
            return sum(chain.scores(f)[t] for f, t in zip(run, p)) + sum(chain.moves[x, y] for x, y in zip((0, *p), (*p, 0)))

        best = max(itertools.product(range(3), repeat=len(run)), key=score)
        assert abs(score(chain.decode(run)) - score(best)) < 1e-9


def test_quality_model(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("thenioasr") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(20, 80))) + "."
    bad = [lambda: " | ".join(word() for _ in range(40)), lambda: "!! ".join(word().upper() for _ in range(40)), lambda: " ".join([word()] * 12 + [word()] * 12)]
    rows = [(k, good() if k % 3 else bad[k // 3 % 3](), 0.5) for k in range(900)] + [(None, None, 0.1), (2000, "", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(900)], "doc_id long, quality int")
    got = quality_model.score_quality(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(got) == 902 and all(0 <= r.score <= 1 for r in got) and len(held) > 100
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.97
    none = quality_model.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def brute_hits(t, items):
    words = decontaminate.words_of(t)
    hit, found = set(), set()
    for k, text in items:
        own = decontaminate.words_of(text)
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if own else 0):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(k))
    items = sorted(found)
    return len(words), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_decontamination(spark, block_bytes):
    rng = random.Random(13)
    word = lambda: rng.choice(["ab", "CD", "éf", "x1", "the", "of", "q"])
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 25)))) for k in range(2, 12)] + [(0, None), (1, "!!"), (30, "UNIQUE"), (31, "unique")]
    texts = [None, "", "..."] + [" ".join(word() for _ in range(60)) for _ in range(40)] + ["pre " + (items[5][1] or "") + " post", "so, " + " ".join((items[3][1] or "").split()[:10]) + "!", "a unique one"]
    df = table(spark, texts, None, "n_hit int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((None if k == 3 else k // 2, *brute_hits(t, items)) for k, t in enumerate(texts))
    assert as_counter(decontaminate.benchmark_hits(df, bench, block_bytes)) == want
    assert {r.contaminated for r in decontaminate.benchmark_hits(df, bench.limit(0)).collect()} == {False}


def test_licenses(spark):
    mit, cc = licenses.TEMPLATES["mit"], licenses.TEMPLATES["cc-by"]
    texts = [None, "", "Under the MIT License, under the mit license", "Apache License, Version 2.0", "cc-by-nc and CC BY NC", "nothing here about of the software", "x " + mit.upper() + " y", "intro " + " ".join(mit.split()[:30]) + " noise noise " + " ".join(mit.split()[30:]), " ".join(mit.split()[:8]), "this is " + cc + ".", "under the mit", "thé under the mit license"]
    got = {r.doc_id: r for r in licenses.scan_licenses(table(spark, texts, list(range(len(texts))), "labels int, score string")).collect()}

    def base(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))

    for k, t in enumerate(texts):
        assert (got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels) == base(t)
        assert set(filter(None, got[k].base_labels.split(","))) <= set(got[k].labels.split(",")) and 0 <= got[k].score <= 1
    assert got[6].labels == got[7].labels == "mit" and got[9].labels == "cc-by" and got[8].labels == got[5].labels == got[10].labels == ""
    model = licenses.automaton()
    noise = lambda t: "intro words " + " ".join(w + (" stray" if k % 25 == 24 else "") for k, w in enumerate(t.split())) + " and more"
    for label, text in licenses.TEMPLATES.items():  # every template, versions of one licence among them, whole and with stray words
        assert licenses.scan(text.upper(), model, [])[5] == label and licenses.scan(noise(text), model, [])[5] == label, label
    both = licenses.TEMPLATES["gpl-3"] + " " + "word " * 50 + licenses.TEMPLATES["bsd-2"]
    assert licenses.scan(both, model, [])[5] == "bsd-2,gpl-3"
    rng = random.Random(31)
    vocabulary = [w for t in licenses.TEMPLATES.values() for w in t.split()]
    for _ in range(200):  # matching statistics equal the longest stretches found by search
        own = [rng.choice(vocabulary).encode() if rng.random() < 0.3 else w for w in rng.choice(list(licenses.TEMPLATES.values())).encode().split()[: rng.randint(4, 40)]]
        lines = [b" " + t.encode() + b" " for t in licenses.TEMPLATES.values()]
        known = lambda a, b, own=own, lines=lines: any(b" " + b" ".join(own[a:b]) + b" " in line for line in lines)
        longest = [max((n for n in range(1, e + 1) if known(e - n, e)), default=0) for e in range(1, len(own) + 1)]
        want = [(e, n) for e, n in enumerate(longest, 1) if n >= licenses.LEAST_STRETCH and (e == len(own) or longest[e] <= n)]
        assert [x[:2] for x in model.stretches(own)] == want
    words = mit.encode().split()
    assert model.stretches([b"x", *words, b"y"])[0][:2] == (len(words) + 1, len(words))


def test_licenses_walk_a_text_of_one_phrase_once():
    import time

    model, phrases = licenses.automaton(), [(f" {k} ".encode(), v) for k, v in licenses.PHRASES.items()]
    n = 400_000
    began = time.process_time()
    got = licenses.scan("so " + "cc by nc " * n, model, phrases)
    assert got[:5] == (3 * n + 1, n, 1, 3 * n - 2, "cc-by-nc") and time.process_time() - began < 60
