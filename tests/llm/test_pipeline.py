import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pinlattice.llm import queries  # noqa: F401
from pinlattice.llm.registry import ORACLES, QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n=90):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    texts = {i: prose(rng) for i in range(40)}
    texts[101] = texts[3]  # copy
    texts[102] = texts[4] + " one more"  # near copy
    texts[103] = prose(rng, 30) + " " + " ".join(f"b{i}" for i in range(12)) + " " + prose(rng, 40)  # benchmark passage
    texts[104] = prose(rng, 60) + " password=abcdefghijkl9 " + prose(rng, 20)
    texts[105] = "short"
    texts[106] = "again and again " * 40
    texts[107] = None
    return texts


def stages(spark, docs, folder, tmp_path):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / f"stage-{name}-{len(out)}")
        stage(spark, docs, folder).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, tables, corpus, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus.items()] + [(5, corpus[5], "en", "s", 1)], COLUMNS)
    folder = tables(
        documents=docs,
        labels=spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, " ".join(f"B{i}" for i in range(12)))], "item_id long, text string"),
    )
    kept = stages(spark, docs, folder, tmp_path)
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    assert ids[0] == sorted([*range(40), 5, 101, 102, 103, 104])
    assert ids[1] == sorted([*range(40), 103, 104])
    assert ids[2] == ids[3] == ids[4] == sorted([*range(40), 104])
    assert all(k.columns == docs.columns for k in kept[:-1])
    final = {r.doc_id: r for r in kept[3].collect()}
    assert final[104].text == corpus[104].replace("password=abcdefghijkl9", "[SECRET]")
    assert final[104].n_chars == len(final[104].text)
    assert all(final[i].text == corpus[i] for i in range(40))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in kept[4].collect():
        want = tokenizer.encode(final[r.doc_id].text, add_special_tokens=False).ids
        assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (len(want), want)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, kept[4].collect()))


def test_empty_table_and_clashing_columns(spark, tables, corpus, tmp_path):
    extra = ", kept string, set long, ids binary, group long, __k1 string, n_hit int, secret_spans string, n_words string, id string"
    rows = [(i, t, "en", None, None, "k", 7, b"x", 8, "y", 9, "z", "w", "i") for i, t in list(corpus.items())[:5]]
    docs = spark.createDataFrame(rows, COLUMNS + extra)
    folder = tables(
        documents=docs,
        labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([], "item_id long, text string"),
    )
    (tmp_path / "full").mkdir()
    kept = stages(spark, docs, folder, tmp_path / "full")
    assert sorted(map(repr, kept[3].collect())) == sorted(map(repr, docs.collect()))
    (tmp_path / "none").mkdir()
    assert [k.count() for k in stages(spark, docs.limit(0), folder, tmp_path / "none")] == [0] * 5


def test_registration():
    names = [n for n in QUERIES if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "bpe_encoding"]
