import random
import re

from pinlattice.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for win, ids in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= ids
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.mark_documents(d, b).select("doc_id", "n_words", "n_hit", "items").collect()
    return sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr)


def test_random_overlaps_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("ab cd ef gh ij kl mn".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 14, 40])))) for i in range(25)]
    docs = []
    for i in range(60):
        body = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            source = items[rng.randrange(25)][1].upper().split()
            start = rng.randrange(len(source))
            body[rng.randrange(len(body) + 1) : 0] = source[start : start + rng.randrange(1, 15)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body)))
    assert run(spark, docs, items) == brute(docs, items)


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    items = [(1, passage), (1, passage), (2, passage), (None, passage), (3, None), (4, ""), (5, "Short one")]
    docs = [(1, None), (2, ""), (3, "!!!"), (4, f"x {passage} y"), (4, f"x {passage} y"), (None, passage), (6, "a short ONE b"), (7, " ".join(passage.split()[:9]))]
    docs.append((8, "z " * 50_000 + passage + " z" * 50_000))
    assert run(spark, docs, items) == brute(docs, items)


def test_full_filter_loses_nothing(spark):
    rows = spark.createDataFrame([(i,) for i in range(1000)], "fp long")
    bits = decontaminate.bit_filter(rows, "fp", 64)
    import numpy as np

    assert decontaminate.passes(bits, np.arange(1000, dtype=np.uint64)).all()


def test_empty_tables_and_other_columns(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]
    odd = spark.createDataFrame([(1, "a b", 7, "k")], "doc_id long, text string, n_hit int, fp string")
    items = spark.createDataFrame([(9, "a b", 1)], "item_id long, text string, size int")
    got = decontaminate.mark_documents(odd, items).first()
    assert (got.n_hit, got.fp, got.contaminated, got["items"]) == (2, "k", True, ["9"])
