import re
from collections import Counter

import numpy as np

from pinlattice.llm import quality

GOOD = " ".join(f"w{i}" for i in range(60))


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
        seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered), failed)


TEXTS = [None, "", "   \n", "a b c a b c a b c", "x\nx\n x\nx\n\ny", "é# $ü <|>", GOOD, GOOD, "a b c " * 30, "tail\n", "\n\n\ntail\ntail"]


def test_counts_against_brute_force(documents):
    rows = documents([(i, t) for i, t in enumerate(TEXTS)])
    judged = quality.judge(rows, "text", np.zeros(64)).orderBy("doc_id").collect()
    assert [tuple(r)[2:8] for r in judged] == [brute(t) for t in TEXTS]
    assert [r.kept for r in judged] == [not brute(t)[-1] for t in TEXTS]


def test_log_ratio_separates_trusted_from_raw(spark, documents):
    good = [(i, " ".join(f"g{(i * 7 + k) % 53}" for k in range(56))) for i in range(40)]
    bad = [(100 + i, " ".join(f"#b{(i * 5 + k) % 53}" for k in range(56))) for i in range(40)]
    docs = documents(good + bad + [(None, None), (None, "x")])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(105, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    raw, target = quality.target_counts(quality.trusted_rows(docs, labels, "doc_id", "text"), "text", "trusted", 4096)
    judged = quality.judge(docs, "text", quality.log_ratio(raw, target, smoothing=0.01))
    kept = {r.doc_id: r.kept for r in judged.collect() if r.doc_id is not None}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in bad)


def test_counts_cover_all_rows_and_both_models(spark, documents):
    docs = documents([(1, "a b"), (2, "a"), (2, "a")])
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    raw, target = quality.target_counts(quality.trusted_rows(docs, labels, "doc_id", "text"), "text", "trusted", 1024)
    assert raw.sum() == 5 and target.sum() == 2


def test_without_trusted_rows_only_base_rules_decide(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(documents([(1, GOOD), (2, "short")]), labels).orderBy("doc_id").collect()
    assert [(r.llr, r.kept) for r in got] == [(0.0, True), (0.0, False)]


def test_empty_table_and_clashing_columns(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = quality.quality_rules(documents([]), labels)
    assert empty.count() == 0
    odd = documents([(1, GOOD, "old", 5)], "doc_id long, text string, kept string, trusted int")
    got = quality.quality_rules(odd, labels).first()
    assert got.kept is True and got.trusted == 5
