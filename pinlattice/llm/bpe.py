"""BPE encoding and decoding through a table of distinct words.

Texts are split into the words of the tokenizer's own pre-tokenization inside
Spark tasks; each distinct word of the corpus is encoded once and its ids are
joined back by position. Decoding is a join too: the ids of the distinct words
are joined with the id-to-piece table (its size is the vocabulary's, so it travels
with the tasks), and the pieces of a text follow from its words by position.
The tokenizer file is a parameter and is read on the driver.

Texts whose characters are all in Latin-1 are split by one regular expression
that agrees with the tokenizer there; every other text is normalized and split by
the tokenizer library itself. Special tokens in a text are words of their own.

Defined results: null and empty texts have no ids and decode to an empty text;
equal rows get equal results. Columns named like a new one are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField
from tokenizers import Tokenizer, pre_tokenizers

from pinlattice.llm.batches import add_columns
from pinlattice.llm.distinct_words import BLOCK_BYTES, join_words

# FIXED VALUES: the word pattern of the tokenizer, spelled out for lower-cased Latin-1.
_SPACE = "\\t-\\r\\x20\\x85\\xa0"
_LETTER = "a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\xff"
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """Splits texts into words as the tokenizer does."""

    def __init__(self, definition: str):
        self.definition = definition
        self._ready = False

    def _prepare(self) -> None:
        self.tokenizer = Tokenizer.from_str(self.definition)
        specials = [t["content"] for t in json.loads(self.definition)["added_tokens"]]
        self.specials = set(specials)
        # Longer ones first, so none hides behind its own beginning.
        ordered = sorted(specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, ordered)) + ")") if specials else None
        self._ready = True

    def __getstate__(self):
        return {"definition": self.definition, "_ready": False}

    def _plain(self, text: str) -> list[str]:
        if _is_latin(text):
            return _LATIN.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def __call__(self, text: str) -> list[str]:
        if not self._ready:
            self._prepare()
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.specials else self._plain(part)
        return out


class Encoder:
    """The ids of one word as little-endian unsigned 32-bit integers."""

    def __init__(self, definition: str):
        self.model = Tokenizer.from_str(definition).model
        self.mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.specials = {t["content"]: t["id"] for t in json.loads(definition)["added_tokens"]}

    def __call__(self, word: str) -> bytes:
        if word in self.specials:
            return np.array([self.specials[word]], "<u4").tobytes()
        ids = [t.id for piece, _ in self.mapped.pre_tokenize_str(word) for t in self.model.tokenize(piece)]
        return np.array(ids, "<u4").tobytes()


def piece_table(definition: str) -> pa.Array:
    """The id-to-piece table: the piece of id i at position i. One entry per vocabulary entry."""
    vocabulary = Tokenizer.from_str(definition).get_vocab(with_added_tokens=True)
    table: list[str | None] = [None] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        table[i] = piece
    return pa.array(table, pa.string())


def join_pieces(ids: Sequence[bytes], table: pa.Array) -> list[str]:
    """Each id sequence joined with the id-to-piece table, pieces in order and separated by a space."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), table.take(pa.array(flat)))
    return pc.binary_join(lists, " ").to_pylist()


def decode_documents(rows: DataFrame, tokenizer_path: str, ids: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``decoded`` to rows with packed ``ids`` (null: empty) of any origin."""
    with open(tokenizer_path, encoding="utf-8") as file:
        table = piece_table(file.read())

    def compute(columns):
        for column in columns:
            yield [pa.array(join_pieces([x or b"" for x in column.to_pylist()], table), pa.string())]

    return add_columns(rows, ids, compute, [StructField("decoded", StringType())], keep)


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    keep: Sequence[str] | None = None,
    splitter: Callable[[str], list[str]] | None = None,
    decode: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and, unless told otherwise, ``decoded``."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    split = splitter or Splitter(definition)
    pieces = piece_table(definition)

    def words_of(texts: pa.ChunkedArray) -> Iterable[str]:
        found: set[str] = set()
        for value in texts:
            found.update(split(value.as_py() or ""))
        return found

    def values_of(words: list[str], _: dict) -> list[bytes]:
        encode = Encoder(definition)
        return [encode(word) for word in words]

    def combine(texts: pa.ChunkedArray, words: list[str], values: list[bytes]) -> Sequence:
        ids = dict(zip(words, values, strict=True))
        shown = dict(zip(words, join_pieces(values, pieces), strict=True)) if decode else {}
        packed, decoded = [], []
        for value in texts:
            found = split(value.as_py() or "")
            packed.append(b"".join(map(ids.__getitem__, found)))
            if decode:
                decoded.append(" ".join(map(shown.__getitem__, found)))
        counts = np.array([len(p) // 4 for p in packed], np.int64)
        return [counts, pa.array(packed, pa.binary()), *([pa.array(decoded, pa.string())] if decode else [])]

    fields = [StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    fields += [StructField("decoded", StringType())] if decode else []
    return join_words(docs, text, words_of, values_of, combine, fields, keep, block_bytes=block_bytes)
