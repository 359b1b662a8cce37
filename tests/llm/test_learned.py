"""Language identification and toxicity: held-out accuracy and edges."""

import random
import zlib

import numpy as np
import pytest

from pinlattice.llm import language, queries, toxicity  # noqa: F401
from pinlattice.llm.registry import QUERIES, table

SF = "/root/testdata/sf0.01"
LETTERS = {"aa": "abcde", "bb": "bcdef", "cc": "xyzéü"}


def sentence(rng, lang, n=12):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    train = spark.createDataFrame(rows[:120] + [(None, None, "aa"), (None, "abc", None)], "doc_id long, text string, lang string")
    test = spark.createDataFrame(rows[120:], "doc_id long, text string, lang string")
    got = language.identify(test, train).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, documents):
    train = spark.createDataFrame([(1, "hello there friend", "en"), (2, "bonjour mon ami", "fr")], "doc_id long, text string, lang string")
    texts = [None, "", "123 .,!", "hello", "hello", "ß日本", "bonjour " * 30_000]
    got = {i: r for i, r in enumerate(language.identify(documents([(i, t) for i, t in enumerate(texts)]), train).orderBy("doc_id").collect())}
    assert [got[i].lang_pred for i in range(7)][:5] == ["und", "und", "und", "en", "en"]
    assert got[6].lang_pred == "fr" and got[5].lang_pred in ("en", "fr")
    assert [got[i].score for i in range(3)] == [0, 0, 0]
    nothing = language.identify(documents([(1, "hello")]), train.limit(0)).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0)
    single = language.identify(documents([(1, "hello")]), train.limit(1)).first()
    assert (single.lang_pred, single.score) == ("en", 1)
    assert language.identify(documents([]), train).count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = spark.createDataFrame([("x", "abab abba b"), ("y", "bb ba")], "lang string, text string")
    models = language.train(rows, order=3)
    alphabet = [chr(c) for c in range(1, 300)]
    base, _ = models.log_probability(["a" + c for c in alphabet])
    prefix, _ = models.log_probability(["a"])
    assert np.isfinite(base).all() and prefix.shape == (1, 2)


def test_held_out_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    got = QUERIES["op7_language_id"](spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [truth[r.doc_id] == r.lang_pred for r in got if r.held_out]
    assert np.mean(held) >= 0.98


def test_toxic_words_are_learned(spark, documents):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = [f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["vilename", "grubber", "grubbing", "grubbed", "nastyone"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = documents([r[:2] for r in rows] + [(None, None)])
    labels = spark.createDataFrame([(i, 0, t) for i, _, t in rows[:500]] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    scorer = toxicity.train(toxicity.labelled_sample(docs, labels, "doc_id", "text"))
    fresh = documents([(i, t) for i, t, _ in rows[500:]] + [(900, "the grubby one"), (901, None), (902, ""), (903, "clean " * 30_000), (904, "you NastyOne!")])
    got = {r.doc_id: r for r in toxicity.score_texts(fresh, scorer).collect()}
    right = [got[i].predicted == t for i, _, t in rows[500:]]
    assert np.mean(right) >= 0.97
    assert got[904].predicted == 1 and got[901].score == got[902].score == got[903].score and got[901].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize(("toxic", "score"), [([], 0), ([0, 0], 0), ([1, 1], 1)])
def test_toxicity_without_both_classes(spark, documents, toxic, score):
    docs = documents([(1, "a b"), (2, "c d")])
    labels = spark.createDataFrame([(i + 1, 0, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    scorer = toxicity.train(toxicity.labelled_sample(docs, labels, "doc_id", "text"))
    assert [round(r.score) for r in toxicity.score_texts(docs, scorer).collect()] == [score, score]
    assert toxicity.score_texts(docs.limit(0), scorer).count() == 0


def test_label_model_finds_the_better_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    good = np.stack([np.where(truth, rng.random(4000) < 0.7, rng.random(4000) < 0.02) for _ in range(4)], axis=1)
    poor = (rng.random((4000, 1)) < 0.2)
    copies = np.repeat(good[:, :1], 3, axis=1)
    votes = np.concatenate([good, poor, copies], axis=1)
    model = toxicity.fit_label_model(votes, np.where(votes[:, :4].any(axis=1), 0.6, 0.05))
    assert (model.on_toxic[:4] > 0.5).all() and (model.on_clean[:4] < 0.1).all()
    assert abs(model.on_toxic[4] - model.on_clean[4]) < 0.1
    assert model.own[0] < 0.5 < model.own[1]
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.95
