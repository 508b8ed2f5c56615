import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from spanline.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("thenioasr") for _ in range(rng.randint(3, 8)))
    good = [" ".join(word() for _ in range(60)) for _ in range(120)]
    bad = [" | ".join(word() for _ in range(60)) for _ in range(60)]
    passage = " ".join(word() for _ in range(14))
    texts = good + bad + [good[0], good[1] + " " + word(), "pre " + good[2] + " " + passage + " " + good[3], good[4] + ' token = "' + "0123456789abcdef" * 3 + '"']
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 120), 0) for k in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "secrets":
            assert "0123456789abcdef" not in docs.where("doc_id = 183 OR doc_id = 4").first().text
    assert not seen["quality"] & set(range(120, 180)) and len(seen["quality"]) >= 120
    assert {180, 181}.isdisjoint(seen["near_duplicates"]) and {0, 1} <= seen["near_duplicates"]
    assert 182 not in seen["decontaminate"] and seen["secrets"] == seen["decontaminate"] == seen["bpe"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["bpe"]


def test_stages_with_odd_rows_and_names(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("thenioasr") for _ in range(rng.randint(3, 8)))
    good = [" ".join(word() for _ in range(60)) for _ in range(60)]
    passage = " ".join(word() for _ in range(14))
    long = " ".join(word() for _ in range(9000)) + "<|endoftext|>" + " ".join(word() for _ in range(3000))
    texts = [*good, None, None, "", good[0], good[0], passage, long, long]
    names = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "__own", "__id", "__doc", "__th", "__n", "__hit", "__more", "__bpe", "__quality", "__clean", "__text", "__found", "fp", "root", "e", "row"]
    kinds = ["long", "string", "string", "string", "long", *["int"] * (len(names) - 5)]
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    rows = [(None if k == 61 else k - (k == 64), t, None if k % 7 == 0 else "en", None if k % 5 == 0 else "s", 1, *range(k, k + len(names) - 5)) for k, t in enumerate(texts)]
    spark.createDataFrame([(k, 1 if k % 2 else 0, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"quality": None, "near_duplicates": len(texts) - 3, "decontaminate": len(texts) - 1, "secrets": len(texts), "bpe": len(texts)}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(rows, schema).repartition(3)
        out = stage(spark, docs, str(tmp_path))
        assert name == "bpe" or (out.columns == names and out.dtypes == docs.dtypes)
        got = out.collect()
        assert want[name] is None or len(got) == want[name], name
        if name != "bpe":  # every other column is as it was
            assert {tuple(r)[2:] for r in got} <= {r[2:] for r in rows}
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in got if r.text == good[0]) == [0] and sum(r.text == long for r in got) == 1
        if name == "bpe":
            assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and all(r.n_tokens == (0 if not texts[r.doc_id] else r.n_tokens) for r in got if r.doc_id is not None)
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == out.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_each_query_covers_its_table(spark, name):
    """A row a document, or a conversation; the trie's root has all conversations."""
    convs = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    if name == "op13_prefix_trie":
        assert QUERIES[name](spark, SF).where("depth = 0").first().n_convs == convs
    else:
        assert QUERIES[name](spark, SF).count() == (convs if name == "op12_dialogue_repair" else spark.read.parquet(f"{SF}/documents.parquet").count())
