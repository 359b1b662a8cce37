"""BPE round trips, partial matching and sharding."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pinlattice.llm import bpe, ppm, queries, sharding  # noqa: F401
from pinlattice.llm.distinct_words import text_blocks
from pinlattice.llm.registry import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def odd_texts(n=150):
    rng = random.Random(11)
    parts = ["Hello", "we'll", "'S", "don't", "é", "É", "é", "ß", "ẞ", "İ", "ǅ", "日本", "½", "²", "12", " ", "\n", "\xa0", "\x85", "\x1c", " ", "_", "...", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "😀", "\x00", "ªº", "Ⅷ", "ア"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_encoding_equals_the_tokenizer(documents, tokenizer):
    texts = [None, "", " ", "x " * 30_000, *odd_texts()]
    rows = documents([(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "null id")])
    got = bpe.encode_documents(rows, PATH).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        ids, decoded = expected(tokenizer, r.text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert (r.n_tokens, r.decoded) == (len(ids), decoded)


def test_decode_of_any_rows(spark, tokenizer):
    packed = [np.array(x, "<u4").tobytes() for x in ([3306, 86, 49407], [], [0])] + [None]
    rows = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(packed)], "k int, ids binary, decoded2 string")
    got = [r.decoded for r in bpe.decode_documents(rows, PATH).orderBy("k").collect()]
    assert got == [tokenizer.decode([3306, 86, 49407], skip_special_tokens=False), "", tokenizer.decode([0], skip_special_tokens=False), ""]


def test_encoding_of_an_empty_table_and_other_columns(spark):
    rows = spark.createDataFrame([(1, "a b", "w", 2)], "doc_id long, text string, word string, block int")
    assert bpe.encode_documents(rows.limit(0), PATH).count() == 0
    got = bpe.encode_documents(rows, PATH).first()
    assert (got.word, got.block, got.n_tokens) == ("w", 2, 2)


def plain_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def slow_ppm(words, ends, order):
    """Method D with exclusion, byte by byte, from dictionaries."""
    counts = {}
    for word, n in words.items():
        token = b" " + word.encode() + b" "
        for j in range(1, len(token)):
            for k in range(min(order, j) + 1):
                counts.setdefault(token[j - k : j], Counter())[token[j]] += n
    for context in (b"", b" ") if ends else ():
        counts.setdefault(context, Counter())[10] += ends

    def code(context, symbol):
        out, excluded = 0.0, set()
        for k in range(min(order, len(context)), -1, -1):
            node = counts.get(context[len(context) - k :])
            if node is None:
                continue
            left = {s: n for s, n in node.items() if s not in excluded}
            if not left:
                continue
            total = 2 * sum(left.values())
            if symbol in left:
                return out + math.log10((2 * left[symbol] - 1) / total)
            out += math.log10(len(left) / total)
            excluded |= set(left)
        return out - math.log10(256 - len(excluded))

    def word_cost(word):
        token = b" " + word.encode() + b" "
        return sum(code(token[:j], token[j]) for j in range(1, len(token)))

    return word_cost, code(b" ", 10)


def test_scoring_against_a_slow_model(documents):
    rng = random.Random(2)
    train = [(i, " ".join(rng.choice(["the", "then", "Thé", "anthem", "x", "zz9"]) for _ in range(rng.randrange(0, 12)))) for i in range(30)]
    test = [(100, None), (101, ""), (102, "the unseen ŧ then"), (102, "the unseen ŧ then"), (None, "zzz " * 200)]
    got = ppm.score_texts(documents(train + test), documents(train), order=3).collect()
    assert len(got) == 35
    counts = Counter(w for _, t in train for w in plain_tokens(t))
    n, v = sum(counts.values()), len(counts)
    ends = counts.pop("\n")
    cost, end = slow_ppm(counts, ends, 3)
    counts["\n"] = ends
    for r in got:
        tokens = plain_tokens(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel_tol=1e-9)
        assert math.isclose(r.score, sum(map(cost, tokens[:-1])) + end, rel_tol=1e-9)


def test_model_is_a_distribution():
    words = pa.array(["ab", "abc", "b"])
    trie_pairs = {}
    symbols, context, at = ppm._contexts(words, 2)
    for k in range(3):
        use = at[1] >= k
        for key in ((ppm._context_keys(context[use], k) << np.uint64(8)) | symbols[use]).tolist():
            trie_pairs[key] = trie_pairs.get(key, 0) + 5
    trie = ppm.Trie.build(2, np.array(list(trie_pairs), np.uint64), np.array(list(trie_pairs.values())), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for before, place in ((ord(" "), 1), ((ord(" ") << 8) | ord("a"), 2), ((ord("a") << 8) | ord("b"), 3)):
        total = 10 ** trie._log10(np.arange(256, dtype=np.uint8), np.full(256, before, np.uint64), np.full(256, place))
        assert math.isclose(total.sum(), 1.0, rel_tol=1e-9)


def test_scoring_without_training_rows(documents):
    rows = documents([(1, "a")])
    got = ppm.score_texts(rows, rows.limit(0)).first()
    assert (got.n_known, got.train_tokens) == (0, 0) and math.isfinite(got.score)
    assert ppm.score_texts(rows.limit(0), rows).count() == 0


def test_no_pair_is_left_out(documents):
    # 1.1 million times one word: a floor of 2 in a million would drop each rare one.
    common = [(i, "aa " * 11_000) for i in range(100)]
    rare = [(1000, "qzx"), (1001, "vjk")]
    got = {r.doc_id: r.score for r in ppm.score_texts(documents(rare), documents(common + rare)).collect()}
    cost, end = slow_ppm(Counter({"aa": 1_100_000, "qzx": 1, "vjk": 1}), 102, 6)
    assert math.isclose(got[1000], cost("qzx") + end, rel_tol=1e-9) and math.isclose(got[1001], cost("vjk") + end, rel_tol=1e-9)


def stream_scores(train, texts, order):
    """Method D with exclusion over whole token streams, from dictionaries; six bytes stand before each text."""
    streams = [b"\n" * 5 + b" " + b"".join(w.encode() + b" " for w in plain_tokens(t)[:-1]) + b"\n" for t in train]
    counts = {}
    for stream in streams:
        for j in range(6, len(stream)):
            for k in range(order + 1):
                counts.setdefault(stream[j - k : j], Counter())[stream[j]] += 1

    def code(context, symbol):
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            left = {s: n for s, n in counts.get(context[6 - k :], {}).items() if s not in excluded}
            total = 2 * sum(left.values())
            if symbol in left:
                return out + math.log10((2 * left[symbol] - 1) / total)
            if left:
                out += math.log10(len(left) / total)
            excluded |= set(left)
        return out - math.log10(256 - len(excluded))

    out = []
    for t in texts:
        stream = b"\n" * 5 + b" " + b"".join(w.encode() + b" " for w in plain_tokens(t)[:-1]) + b"\n"
        out.append(sum(code(stream[j - 6 : j], stream[j]) for j in range(6, len(stream))))
    return out


@pytest.mark.parametrize("order", [1, 4, 6])
def test_contexts_across_tokens_against_a_slow_model(documents, order):
    rng = random.Random(5)
    train = [" ".join(rng.choice(["the", "then", "Thé", "of a", "x", "zz9"]) for _ in range(rng.randrange(0, 12))) for i in range(40)]
    texts = [*train[:5], None, "", " \n", "The unseen\tŧ of  a then", "a of the", "the of a", "zzz " * 300]
    got = ppm.score_texts(documents(list(enumerate(texts))), documents(list(enumerate(train))), order=order, across=True).collect()
    want = stream_scores(train, texts, order)
    assert len(got) == len(texts)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9)


def test_the_order_of_words_counts(tables, spark, documents):
    # doc ids 0.. are both trained on and scored by the query.
    fluent = "one little fox ran over one big hill"
    rows = [(i, fluent) for i in range(40)] + [(100, "hill big one over ran fox little one")]
    got = {r.doc_id: r.score for r in QUERIES["op9_ppm_scoring"](spark, tables(documents=documents(rows))).collect()}
    assert got[0] > got[100] + 5


def test_values_travel_in_few_bytes(documents):
    # Where the longest context has the symbol, two small numbers travel and not the eight bytes of their logarithm.
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(300)) for _ in range(60)]
    rows = documents(list(enumerate(texts))).select(F.lit(True), "text").coalesce(1)
    shared = ppm.shared_pairs(ppm.training_counts(rows, "text", ppm.ORDER, True), ppm.ORDER)
    got = ppm.key_scores(text_blocks(rows, 1 << 20), None, shared, 2, ppm.ORDER, True).collect()
    keys = sum(len(ppm._unpack_numbers(r.words, np.uint64)) for r in got)
    assert keys == sum(len(ppm._unpack_values(r.vals)) for r in got) > 20_000
    assert sum(len(r.vals) for r in got) < 2 * keys


def test_packed_values_are_exact():
    count, total, value = np.array([3, 0, 1, 0, 1 << 40]), np.array([9, 0, 1, 0, 1 << 41]), np.array([7, -2.5, 7, -1e-300, 7])
    got = ppm._unpack_values(ppm._pack_values(count, total, value)).tolist()
    assert got == [math.log10(5 / 18), -2.5, math.log10(1 / 2), -1e-300, math.log10(((1 << 41) - 1) / (1 << 42))]
    assert len(ppm._unpack_values(ppm._pack_values(count[:0], total[:0], value[:0]))) == 0


def test_training_rows_named_by_a_condition(documents):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "then", "Thé", "of a", "x", "zz9"]) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    docs = documents([*rows, (None, "the then"), (61, None)])
    apart = ppm.score_texts(docs, docs.filter("doc_id < 40"), across=True)
    inside = ppm.score_texts(docs, F.col("doc_id") < 40, across=True)
    assert inside.columns == apart.columns
    for got, want in zip(*[sorted(x.collect(), key=repr) for x in (inside, apart)], strict=True):
        assert got[:-1] == want[:-1] and math.isclose(got.score, want.score, rel_tol=1e-12)


def test_index_finds_every_key_and_refuses_others():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 50, 5000).astype(np.uint64))
    index = ppm._Index(keys)
    asked = rng.choice(keys, 20_000)
    assert (keys[index.order][index.places(asked, "a key")] == asked).all()
    with pytest.raises(RuntimeError):
        index.places(np.array([1 << 51], np.uint64), "a key")
    with pytest.raises(RuntimeError):
        ppm._Index(keys[:0]).places(asked, "a key")
    assert len(ppm._Index(keys[:0]).places(keys[:0], "a key")) == 0


def test_matrix_has_exact_margins():
    rng = np.random.default_rng(4)
    blocks = rng.integers(0, 200, 30)
    sizes = sharding.exact_sizes(int(blocks.sum()), 7)
    matrix = sharding.communication_matrix(blocks, sizes)
    assert (matrix >= 0).all() and (matrix.sum(axis=1) == blocks).all() and (matrix.sum(axis=0) == sizes).all()
    # Hypergeometric mean over many seeds.
    mean = np.mean([sharding.communication_matrix([40, 60], [30, 70], seed)[0, 0] for seed in range(2000)])
    assert abs(mean - 12) < 0.3
    huge = sharding.communication_matrix([3 * 10**9, 10**9], [10**9, 3 * 10**9])
    assert huge.sum(axis=0).tolist() == [10**9, 3 * 10**9] and abs(int(huge[0, 0]) - 750_000_000) < 10**6


def test_shards_are_exact_and_slots_gapless(documents):
    rows = documents([(i % 900, f"t{i % 300}") for i in range(1000)] + [(None, None)] * 3)
    dealt = sharding.shard_rows(rows, 24, ["doc_id", "text"], block_rows=100)
    again = sharding.shard_rows(rows, 24, ["doc_id", "text"], block_rows=100)
    got = dealt.collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 1003 and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert sorted(map(repr, got)) == sorted(map(repr, again.collect()))
    # Neighbours by id do not stay together.
    first = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert np.mean(np.abs(np.diff(first))) > 200
    plan = dealt._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sharding_of_an_empty_table_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 9, "x")], "doc_id long, slot long, shard string")
    assert sharding.shard_rows(rows.limit(0), 3, ["doc_id"]).count() == 0
    got = sharding.shard_rows(rows, 3, ["doc_id"]).first()
    assert got.shard in (0, 1, 2) and got.slot == 0


def test_null_ids_of_folds(spark):
    row = spark.range(1).select(ppm.fold(F.lit(None).cast("long"), 10).alias("f")).first()
    assert row.f == 0 and hashlib.sha256(b"").hexdigest()
