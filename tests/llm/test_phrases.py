"""Collocations against plain counting; passes of the partitioned mining on small pieces."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pinlattice.llm import phrases


def pieces_of(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", text)]


def plain(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for words in pieces_of(text):
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])

    def inside(p, q):
        return len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))

    out = []
    for lang in n:
        mine = {p: v for (x, p), v in found.items() if x == lang}
        kept = [p for p, v in mine.items() if not any(inside(p, q) and 100 * w[1] >= 80 * v[1] for q, w in mine.items())]
        kept.sort(key=lambda p: (-mine[p][0], -mine[p][1], " ".join(p).encode()))
        for rank, p in enumerate(kept[:top], 1):
            score, a, left, right = mine[p]
            out.append((lang, rank, " ".join(p), a, left, right, n[lang], score))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mined(spark, rows, parts=5, **options):
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "text string, lang string, a long, phrase string").repartition(parts)
    return sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs, **options).collect())


def corpus(seed, n, vocabulary="the cat Sat on\tmat été über a b c d-e x"):
    r = random.Random(seed)
    words = vocabulary.split(" ")
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(r.randrange(60)):
            text += r.choice(words) + r.choice([" ", " ", " ", "  ", "\t ", ", ", ".", "\n", "\x0b"])
        rows.append((text, r.choice(["en", "fr", None])))
    return rows


def test_collocations_against_plain_counts(spark):
    rows = corpus(1, 400) + [(None, "en"), ("", None), ("one", ""), ("New York City is big. " * 40, "en"), ("Z z " * 3000, "fr"), ("…;!?", "de")]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows, parts=1) == plain(rows)


def test_top_and_ties(spark):
    rows = [(f"{a}{b} z{a}{b}!", "en") for a in "abcdé" for b in "ABCdü" for _ in range(35)]
    assert mined(spark, rows, top=7) == plain(rows, top=7)
    assert len(mined(spark, rows)) == 25


def test_support_is_met_exactly(spark):
    rows = [("p q", "en")] * 29 + [("r s", "en")] * 30
    assert [x[2] for x in mined(spark, rows, parts=29)] == ["r s"]


def test_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []


def test_full_filter_only_costs_time(spark, monkeypatch):
    rows = corpus(2, 300)
    monkeypatch.setattr(phrases, "candidate_filter", lambda candidates: (b"\xff" * 512, 4096))
    assert mined(spark, rows) == plain(rows)


def test_packed_lists_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        values = np.unique(r.integers(0, 1 << 32, n, dtype=np.uint64)).astype(np.uint32)
        counts = r.integers(1, 4, len(values))
        v, c = phrases._read(phrases._write(values, counts))
        assert v.tolist() == values.tolist() and c.tolist() == counts.tolist()


@pytest.mark.parametrize("support, shards", [(30, 14), (30, 29), (7, 14)])
def test_pigeonhole(support, shards):
    local = -(-support // shards)
    assert shards * (local - 1) < support
