"""Filter interactions against a plain computation over all orders."""

from itertools import permutations

import pytest

from pinlattice.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(220))


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    fails = []
    for i, text, lang, *_ in docs:
        text = text or ""
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        words = [w for w in text.split(" ") if w]
        marks = set()
        if len(words) < 200:
            marks.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            marks.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            marks.add("C")
        if set(text) & set("#$%&*|"):
            marks.add("D")
        original = docs[len(fails)][1] or ""
        if i is not None and original in least and i > least[original]:
            marks.add("E")
        fails.append((i, lang or "", marks))
    out = {}
    for part in {p for _, p, _ in fails}:
        mine = [(i, m) for i, p, m in fails if p == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive),
                    len(gone),
                    sum(f in m for _, m in mine) - len(gone),
                    sum(m == {f} for _, m in mine),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, n long, k1 string, id string, part string, least string")
    found = filter_audit.audit_documents(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = found.collect()
    out = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in rows}
    assert len(out) == len(rows)
    return out


def clash(rows):
    return [(*r, 5, "x", "y", "z", "q") for r in rows]


def test_all_orders_against_plain_sets(spark):
    docs = [
        (1, LONG, "en"),
        (2, LONG, "en"),
        (2, LONG, "en"),
        (3, LONG, "fr"),
        (None, LONG, "en"),
        (4, None, None),
        (4, "", "en"),
        (5, "Short & LOUD\x0bTEXT", "en"),
        (6, LONG + " " + LONG + " " + LONG, "fr"),
        (7, LONG.upper() + " #", "fr"),
        (8, "Été " * 300, ""),
        (9, "word " * 40_000, "en"),
        (None, None, "en"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (None, 1, 1), (99, 1, 1), (7, 0, 1), (9, 1, 1)]
    assert run(spark, clash(docs), labels) == plain(docs, labels)


def test_hot_text_and_hot_id(spark):
    docs = [(i, "same text", "en") for i in range(2500)] + [(7, f"text {i}", "en") for i in range(1500)]
    labels = [(7, 1, 0)] * 3
    assert run(spark, clash(docs), labels) == plain(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    found = run(spark, clash([(1, LONG, "en")]), [])
    assert found["en", "ABCDE", 5] == [1, 0, 0, 0, 0, 0, 0] and len(found) == 600


def test_filters_of_ones_own(spark):
    rows = spark.createDataFrame([(1, 0, "p", 2, 0, 1), (2, 0, "p", 1, 1, 0)], "k1 long, k2 long, part string, n long, good long, toxic long")
    ids = spark.createDataFrame([(1, 0)], "k1 long, k2 long")
    found = {(r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in filter_audit.audit(rows, {"X": ids, "Y": ids}).collect()}
    assert found["XY", 1] == (1, 2, 0, 0, 0, 1, 2) and found["XY", 2] == (1, 0, 2, 0, 0, 0, 2)
    with pytest.raises(ValueError):
        filter_audit.audit(rows, dict.fromkeys("ABCDEFG", ids))
