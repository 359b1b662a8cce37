"""Threshold-scaled sketches against a plain computation, and the edited copies in order of ids."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from pinlattice.llm import fingerprints as fp
from pinlattice.llm.batches import Piece, mix

MASK = (1 << 64) - 1


def plain_sketch(text, shingle=fp.SHINGLE, scale=fp.SCALE):
    raw = (text or "").encode()
    if not raw:
        return []
    size = min(shingle, len(raw))
    hashes = set()
    for i in range(len(raw) - size + 1):
        h = sum(int(fp._CODE[b]) * pow(fp._BASE, j, 1 << 64) for j, b in enumerate(raw[i : i + size])) & MASK
        h = (h + (size if size < shingle else 0)) & MASK
        hashes.add(int(mix(np.array([h], np.uint64))[0]) >> (64 - fp.HASH_BITS))
    low = sorted(h for h in hashes if h < (1 << fp.HASH_BITS) // scale)
    return low or [min(hashes)]


def alike(a, b):
    if not a or not b:
        return float(a == b)
    return len(set(a) & set(b)) / min(len(a), len(b))


def hexed(sketch):
    return "".join(f"{h:012x}" for h in sketch)


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["café", "lumière", "house", "stone", "river", "ÿ", "a", "longerword", "x1"]) for _ in range(n))


def test_windows_of_any_length():
    data = np.frombuffer(words(1, 20).encode(), np.uint8)
    for length in (1, 2, 3, 5, 7, 12, 16, 23):
        slow = [sum(int(fp._CODE[b]) * pow(fp._BASE, j, 1 << 64) for j, b in enumerate(data[i : i + length].tolist())) & MASK for i in range(len(data) - length + 1)]
        assert fp._windows(data, length).tolist() == slow


def test_sketches_of_a_piece():
    texts = ["", "a", "short text", "x" * 16, words(2, 40), "", words(3, 300), "b"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    hashes, at = fp.sketches(Piece(np.frombuffer(b"".join(raw), np.uint8), offsets))
    for i, t in enumerate(texts):
        assert hashes[at[i] : at[i + 1]].tolist() == plain_sketch(t)


def check(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string, h long, part string").repartition(parts)
    found = fp.compare_edited(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    expected = []
    for i, (doc, text, _, h, part) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        own, other = plain_sketch(text), plain_sketch(edited)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        near = alike(own, other), alike(own, plain_sketch(after))
        expected.append((doc, h, part, len(text), digest, hexed(own), hexed(other), *near))
    names = ("doc_id", "h", "part", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted((tuple(r[c] for c in names) for r in found), key=repr) == sorted(expected, key=repr)
    return found


def test_edited_copies_and_successors(spark):
    rows = [(i * 3, words(i, 5 + i * 7), "clash", i, "p") for i in range(40)]
    rows += [(1, None, None, None, None), (4, "", "x", 1, "y"), (None, "no id é", "x", 1, "y"), (7, "abc", "x", 1, "y"), (200, words(9, 9000), "x", 1, "y")]
    check(spark, rows)
    check(spark, rows, 1)


def test_one_row_and_none(spark):
    check(spark, [(5, words(4, 30), "x", 1, "y")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.compare_edited(empty).collect() == []


def test_repeated_rows_have_equal_fingerprints(spark):
    rows = [(1, words(5, 50), "x", 1, "y")] * 3 + [(1, words(6, 50), "x", 1, "y"), (2, words(5, 50), "x", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string, h long, part string")
    found = fp.compare_edited(docs).collect()
    assert len(found) == 5 and len({r.fingerprint for r in found}) == 2
    # Both other copies of a row follow one of them at least.
    assert sum(r.near_next == 1.0 for r in found) >= 2


def test_near_copies_stand_out(spark):
    base = words(11, 400)
    rows = [(i, words(100 + i, 400), "x", 1, "y") for i in range(30)]
    rows += [(1000, base, "x", 1, "y"), (1001, base + " and a tail", "x", 1, "y")]
    found = {r.doc_id: r for r in check(spark, rows)}
    assert found[1000].near_next > 0.95
    assert all(r.near_edited > 0.45 for r in found.values())


def test_containment_merging_and_likeness(spark):
    docs = spark.createDataFrame([("a", words(1, 200)), ("a", words(2, 200)), ("b", "tiny"), ("b", ""), ("c", None)], "source string, text string")
    sketched = fp.sketch_texts(docs)
    merged = {}
    for r in fp.merged_sketches(sketched, ["source"]).collect():
        merged.setdefault(r.source, []).append(r.hash)
    both = sorted(set(plain_sketch(words(1, 200))) | set(plain_sketch(words(2, 200))))
    assert sorted(merged["a"]) == both and merged["b"] == plain_sketch("tiny") and "c" not in merged
    pair = sketched.filter("source = 'a'").agg(F.array_sort(F.flatten(F.collect_list("sketch"))).alias("all"), F.first("sketch").alias("one"))
    got = pair.select(fp.containment(F.col("one"), F.col("all")).alias("x"), fp.likeness(F.col("all"), F.col("one")).alias("y")).first()
    assert got == (1.0, 1.0)
    none = sketched.filter("source = 'c'").select(fp.containment(F.col("sketch"), F.col("sketch")).alias("x")).first()
    assert none.x == 1.0
