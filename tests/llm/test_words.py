"""Word hashing against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from pinlattice.llm.batches import ALNUM_OR_HIGH, NOT_SPACE, Words, pieces, span_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_texts(seed, n=60):
    rng = random.Random(seed)
    parts = ["a", "B", "é", "日本", " ", "\n", "\t", "\x0b", "12", "-", "\xa0", "\x1c", "x" * 40]
    return [None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_words_equal_a_regular_expression():
    texts = random_texts(1)
    for _, _, piece in pieces(pa.array(texts), 200):
        assert piece.n >= 1
    found = []
    for _, _, piece in pieces(pa.array(texts), 200):
        words = Words(piece, NOT_SPACE, True)
        raw = words.bytes_of(np.arange(len(words.starts)))
        for k in range(piece.n):
            found.append([w.decode() for w in raw[words.bounds[k] : words.bounds[k + 1]]])
    assert found == [SPACE_WORD.findall((t or "").translate(LOWER)) for t in texts]


def test_other_word_class():
    text = "Ab-c_d é1\x7fz [x]"
    piece = next(pieces(pa.array([text])))[2]
    words = Words(piece, ALNUM_OR_HIGH, True)
    got = [w.decode() for w in words.bytes_of(np.arange(len(words.starts)))]
    assert got == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def test_hash_depends_on_the_word_only():
    long_word = "y" * 700_000  # longer than a block of the hash
    texts = [f"q {long_word} z", long_word, "z", None, ""]
    piece = next(pieces(pa.array(texts), 1 << 30))[2]
    words = Words(piece, NOT_SPACE, False)
    assert words.counts.tolist() == [3, 1, 1, 0, 0]
    assert words.hashes[1] == words.hashes[3] and words.hashes[2] == words.hashes[4]
    assert len(set(words.hashes.tolist())) == 3
    data = np.frombuffer(long_word.encode(), np.uint8)
    assert span_hashes(data, np.array([0]), np.array([len(data)]))[0] == words.hashes[1]


def test_grams_stay_inside_texts():
    piece = next(pieces(pa.array(["a b c", "b c", "c"])))[2]
    words = Words(piece, NOT_SPACE, False)
    grams, first = words.grams(2)
    assert first.tolist() == [0, 1, 3]
    assert grams[1] == grams[2]
    assert len(words.grams(4)[0]) == 0


def test_empty_column():
    assert list(pieces(pa.array([], pa.string()))) == []
