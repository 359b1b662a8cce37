import random
import re

import numpy as np
import pytest

from pinlattice.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) * den >= len(a | b) * num:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=repr)


def run(spark, rows, n=3, num=9, den=10, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(frame, shingle=n, numerator=num, denominator=den)
    return sorted(((r.id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = f"e{rng.randrange(1000)}"
        elif kind < 0.7 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"i{rng.randrange(1000)}")
    return words


@pytest.mark.parametrize(("seed", "n", "num", "den"), [(1, 3, 9, 10), (2, 5, 4, 5), (3, 3, 1, 2)])
def test_families_against_brute_force(spark, seed, n, num, den):
    rng = random.Random(seed)
    rows = []
    for size in (1, 2, 3, 4, 9, 10, 11, 30, 60, 120, 300):
        base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
        for _ in range(10):
            rows.append((len(rows) + 1, " ".join(edited(rng, base, rng.randrange(0, max(2, size // 12))))))
    rng.shuffle(rows)
    assert run(spark, rows, n, num, den) == brute(rows, n, num, den)


def test_chain_and_late_links(spark):
    # A sliding window: neighbours link, the ends do not.
    words = [f"c{i}" for i in range(260)]
    rows = [((i * 37) % 101, " ".join(words[i * 2 : i * 2 + 100])) for i in range(80)]
    want = brute(rows, 3, 9, 10)
    assert run(spark, rows) == want
    assert len({c for _, _, c in want}) == 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "One"), (5, "oNE"), (6, "one two"), (6, "one two"), (None, "one two"), (None, "solo text here"), (7, "É x y z"), (8, "é x y z")]
    rows += [(9, "a b " * 40_000), (10, "A b " * 40_000)]
    assert run(spark, rows) == brute(rows, 3, 9, 10)
    assert run(spark, []) == []


def test_many_copies_and_a_shared_passage(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, "same text " + passage) for i in range(300)]
    rows += [(300 + i, " ".join(f"u{rng.randrange(9999)}" for _ in range(50)) + " " + passage) for i in range(120)]
    base = [f"n{i}" for i in range(150)]
    rows += [(500 + i, " ".join(edited(rng, base, 1))) for i in range(120)]
    assert run(spark, rows) == brute(rows, 3, 9, 10)


def test_segments_guarantee_a_shared_key():
    """Every linking pair of random sets shares a key, with all filters open."""
    rng = np.random.default_rng(1)
    rules = jaccard.Rules(3, 9, 10)
    everything = np.full(16, np.iinfo(np.uint64).max)
    for _ in range(150):
        size = int(rng.integers(9, 90))
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        most = int(0.1 / 1.9 * 2 * size)
        drop, add = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)])
        if 10 * (size - drop) < 9 * (size + add):
            continue
        grams, owner = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        keys, at = jaccard.segment_keys(grams, owner, 2, rules.bands(), everything)
        assert set(keys[at == 0].tolist()) & set(keys[at == 1].tolist())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert len(got) == len(roots) == 401
    assert len({roots[i] for i in range(301)}) == 1 and len({roots[i] for i in range(1000, 1100)}) == 1
    assert roots[0] != roots[1000]


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b c d", 5, "x"), (2, "a b c d", 6, "y")], "doc_id long, text string, id long, key string")
    assert {r.component_id for r in jaccard.jaccard_components(rows).collect()} == {1}


def test_all_links_against_brute_force(spark, monkeypatch):
    # Small cells, so that a bucket is cut into a grid.
    monkeypatch.setattr(jaccard, "CELL_ROWS", 7)
    monkeypatch.setattr(jaccard, "CELL_PAIRS", 50)
    rng = random.Random(9)
    base = [f"n{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 5)))) for i in range(60)]
    rows += [(100 + i, rows[i][1].upper()) for i in range(10)]
    rows += [(200 + i, " ".join(f"s{j}" for j in range(i * 2, i * 2 + 100))) for i in range(20)] + [(300, None), (301, "alone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t, 3) for _, t in rows]
    distinct = {s for s in sets if s}
    linked = {s: [t for t in distinct if t != s and len(s & t) * 10 >= len(s | t) * 9] for s in distinct}
    want = {r[0]: len(linked[s]) if s else 0 for r, s in zip(rows, sets, strict=True)}
    got = jaccard.jaccard_components(frame, count_links=True).collect()
    assert {r.id: r.n_links for r in got} == want
    name = {s: next(r.set for r in got if r.id == row[0]) for row, s in zip(rows, sets, strict=True) if s}
    pairs = sorted((name[s], name[t], len(s & t), len(s | t)) for s in distinct for t in linked[s] if name[s] < name[t])
    assert sorted(map(tuple, jaccard.jaccard_links(frame).collect())) == pairs and len(pairs) > 150
    assert {(r.id, r.component_id) for r in jaccard.jaccard_components(frame).collect()} == {(r.id, r.component_id) for r in got}


def test_pairs_grow_with_a_group_of_near_copies(spark, monkeypatch):
    """n near copies that all link cost at most as many comparisons as their bucket rows, and one round."""
    made = []
    once = jaccard.Candidates.once
    monkeypatch.setattr(jaccard.Candidates, "once", staticmethod(lambda met: made.append(once(met)) or made[-1]))
    base = [f"n{i}" for i in range(200)]
    rng = random.Random(3)
    words = [base[:k] + [f"e{i}"] + base[k + 1 :] for i, k in enumerate(rng.choices(range(200), k=1200))]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_components(frame).collect()} == {0}
    counts = [m.count() for m in made]
    assert sum(counts) < 20 * len(rows) and counts[-1] == 0


def test_members_of_buckets_are_narrow(spark):
    # A set is in hundreds of buckets; what is known of it must not be written with each of them.
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(30)]
    rules = jaccard.Rules(5, 4, 5)
    source = jaccard._source(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    candidates = jaccard.Candidates(source.drop("text_key"), jaccard.set_table(source, rules), rules)
    assert sorted(candidates.members.columns) == ["component", "key", "set"]
    pairs = candidates.representative_pairs(0)
    assert pairs.columns == ["key", "a", "b"]
    linked = {(r.set_a, r.set_b) for r in candidates.links(pairs).collect()}
    everything = {(r.set_a, r.set_b) for r in candidates.links(candidates.all_pairs()).collect()}
    assert linked and linked <= everything


def test_long_sets_are_told_apart_before_their_shingles_move(spark):
    # Bits of a fixed number are all used up in long texts; counts by cell grow with the text.
    rng = random.Random(13)
    rules = jaccard.Rules(5, 4, 5)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (9000, 9000, 9900, 100, 100)]
    texts += [edited(rng, texts[0], 150), edited(rng, texts[3], 1)]
    source = jaccard._source(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id", "text")
    table = jaccard.set_table(source, rules)
    names = {r.id: r.set for r in table.collect()}
    pairs = [(1, min(names[i], names[j]), max(names[i], names[j])) for i in names for j in range(i)]
    candidates = jaccard.Candidates(source.drop("text_key"), table, rules)
    left = jaccard.still_open(spark.createDataFrame(pairs, "key long, a long, b long"), candidates.sketches, rules)
    linked = {(0, 5), (3, 6)}
    assert {frozenset((r.a, r.b)) for r in left.collect()} == {frozenset(names[i] for i in p) for p in linked}


def test_counts_by_cell_bound_the_difference():
    rng = np.random.default_rng(14)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 63, 64, 500, 511, 512, 1023, 1025, 5000, 0)]
    sets += [np.append(s[len(s) // 8 :], rng.integers(0, 2**63, 3).astype(np.uint64)) for s in sets]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    packed, starts = jaccard.text_bytes(jaccard.count_sketches(np.concatenate(sets), owner, len(sets)))
    bits = jaccard.cell_bits(np.array([len(s) for s in sets]))
    a, b = np.triu_indices(len(sets), 1)
    for i, j, found in zip(a, b, jaccard.least_differences(packed, starts[:-1], bits, a, b), strict=True):
        wanted = min(bits[i], bits[j])
        one, two = (jaccard.cell_counts(packed, starts[[k]], bits[k], wanted).astype(int) for k in (i, j))
        assert found == np.abs(one - two).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_text_ids(spark):
    rows = [("b", "one two three four"), ("a", "One two three four"), ("c", "five six seven"), (None, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.id, r.component_id) for r in got} == {("b", "a"), ("a", "a"), ("c", "c"), (None, None)}


def test_components_come_with_all_links(spark, monkeypatch):
    """Links between sets that are already in one component count as well, over blocks of a few sets."""
    monkeypatch.setattr(jaccard, "CELL_ROWS", 5)
    monkeypatch.setattr(jaccard, "CELL_TOKENS", 700)
    rng = random.Random(4)
    base = [f"n{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 4)))) for i in range(40)]
    rows += [(100 + i, " ".join(f"s{j}" for j in range(i * 2, i * 2 + 90))) for i in range(12)]
    rows += [(200, rows[3][1].upper()), (201, None), (202, "alone here")]
    sets = {i: shingles(t, 3) for i, t in rows}
    distinct = {s for s in sets.values() if s}
    want = {i: sum(t != s and len(s & t) * 10 >= len(s | t) * 9 for t in distinct) if s else 0 for i, s in sets.items()}
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.n_links for r in got} == want and max(want.values()) > 5
