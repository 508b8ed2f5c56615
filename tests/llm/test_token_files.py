"""Token ids in ORC files against the library, with nulls, ties, repeats and long texts; what lookups read; what the files hold."""

import glob
import random
import zlib

import numpy as np
import pytest

from spanline.llm import queries, token_files
from spanline.llm.common import tokenizer_path
from tests.llm.test_texts import odd_texts

PATH = tokenizer_path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    return lib


def texts():
    rng = random.Random(8)
    letters = [*"abcXYZéÉßŠİıΣσς'’.,-0159½²µº\t \n\u0085  　中ひ한🙂́\x1c\x1f\x00", "'S", "'ll", "'Re", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|> "]
    out = odd_texts() + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    return [*out, "".join(rng.choice("thenioas   ") for _ in range(2_000_000)), "x" * 60_000]


@pytest.mark.parametrize("files", [None, 1, 7])
def test_files_equal_the_library(spark, tmp_path, files):
    every, lib = texts(), library()
    rows = [(None if k % 50 == 3 else k // 2, t, "y", 1) for k, t in enumerate(every)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at string, `a.b` int").repartition(3)
    folder = f"{tmp_path}/ids"
    token_files.write_ids(df, PATH, folder, files=files)
    got = sorted((tuple(r) for r in token_files.places(spark, folder).collect()), key=lambda r: r[1])
    ids = [lib.encode(t or "", add_special_tokens=False).ids + [2] for t in every]
    want = sorted((-1 if r[0] is None else r[0], len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for r, x in zip(rows, ids, strict=True))
    assert sorted((-1 if d is None else d, n, crc) for d, _, n, crc in got) == want
    order = [-1 if r[0] is None else r[0] for r in got]
    assert order == sorted(order) and [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()
    one = token_files.read_ids(spark, folder, [40]).collect()
    assert sorted(map(len, (r.ids for r in one))) == sorted(len(x) for r, x in zip(rows, ids, strict=True) if r[0] == 40)


def test_one_row_repeated_is_dealt_to_several_files(spark, tmp_path):
    df = spark.createDataFrame([(5, "the same words")] * 4000, "doc_id long, text string").repartition(4)
    token_files.write_ids(df, PATH, f"{tmp_path}/ids", files=4)
    parts = token_files.read_ids(spark, f"{tmp_path}/ids").groupBy("part").count().collect()
    assert len(parts) > 2 and sum(r["count"] for r in parts) == 4000


def test_empty_table(spark, tmp_path):
    token_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), PATH, f"{tmp_path}/ids")
    assert token_files.places(spark, f"{tmp_path}/ids").collect() == []


def rows_scanned(df):
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        if "Scan" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
    return sum(found)


def test_lookups_read_row_groups_and_files_hold_filters(spark, tmp_path):
    df = spark.range(0, 40_000, 2).selectExpr("id AS doc_id", "concat('word', id) AS text")
    folder = f"{tmp_path}/ids"
    token_files.write_ids(df, PATH, folder, files=2)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    names = set()
    for file in glob.glob(f"{folder}/*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        records = reader.rows()
        for stripe in reader.getStripes():
            names |= {str(s.getKind()) for s in records.readStripeFooter(stripe).getStreamsList()}
            assert {str(c.getKind()) for c in list(records.readStripeFooter(stripe).getColumnsList())[1:]} == {"DIRECT_V2"}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= names
    assert rows_scanned(token_files.read_ids(spark, folder)) == 20_000
    assert rows_scanned(token_files.read_ids(spark, folder, [7_000])) <= 2 * token_files.ROWS_INDEXED
    assert rows_scanned(token_files.read_ids(spark, folder, [7_001])) <= token_files.ROWS_INDEXED  # within the range of a row group, but in no filter


def test_other_vocabularies_go_through_the_library(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    encoder, lib = token_files.Encoder(path), Tokenizer.from_file(path)
    assert encoder.words is None and token_files.Encoder(PATH).words.by_ranks
    assert encoder.encode("Two  words") == np.array(lib.encode("Two  words", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_ranks_do_what_the_merges_do():
    """Each token's own merges, in the order of the file, lead to it: then a pair whose joint bytes are a token is that token's last merge."""
    import json

    with open(PATH, encoding="utf-8") as file:
        model = json.load(file)["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order, end = {p: k for k, p in enumerate(pairs)}, model["end_of_word_suffix"]
    for token in model["vocab"]:
        body = token.removesuffix(end)
        parts = [*body[:-1], body[-1] + end * token.endswith(end)] if body else []
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: order.get((parts[i], parts[i + 1]), len(order)))
            if (parts[k], parts[k + 1]) not in order:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [token] or not body or token.startswith("<|")


def test_words_equal_the_library():
    rng, encoder, lib = random.Random(4), token_files.Encoder(PATH), library()
    letters = "abcdefghijklmnopqrstuvwxyzéèñüßçøªµºāžƀɏ" * 3 + "'.,;:!?()«»-_0²½…"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(40_000)} | {w for t in texts() if t and token_files.PLAIN.fullmatch(t) for w in t.lower().split()}
    for word in words:
        if token_files.PLAIN.fullmatch(word) and not encoder.special.search(word):
            assert encoder.words[word] == np.array(lib.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes(), word


def test_query(spark):
    got = queries.op11_token_files(spark, "/root/testdata/sf0.001").collect()
    assert [r.start for r in sorted(got, key=lambda r: r.doc_id)][0] == 0 and len(got) == len({r.doc_id for r in got}) == 200
