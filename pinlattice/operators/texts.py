"""Release notes as tables: signal rows, mentions, vocabulary joins, embeddings, reproduction."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import HIGH_SIGNAL_PATTERNS, SIGNAL_PATTERNS
from pinlattice.functions.text import (
    chunk_starts,
    collapse_spaces,
    evidence_lines,
    high_signal_counts,
    meaningful_lines,
    mention_grams,
    signal_counts,
)
from pinlattice.functions.vectors import l2_normalize
from pinlattice.operators.ordered import with_scalars
from pinlattice.operators.violations import explode_rules

FILTER_WORDS = 16_384  # 64 bits each: 128 KB, 1 % of other grams pass at 10,000 names


def text_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """Signal counts and flags, normalized length and line count of every text."""
    t = F.col(text)
    counted = df.select(
        "*",
        F.length(collapse_spaces(t)).alias("selected_characters"),
        F.size(meaningful_lines(t)).alias("selected_lines"),
        signal_counts(t).alias("__signals"),
        high_signal_counts(t).alias("__high"),
        evidence_lines(t).alias("evidence_lines"),
    )
    source = {**{n: "__signals" for n in SIGNAL_PATTERNS}, **{n: "__high" for n in HIGH_SIGNAL_PATTERNS}}
    return counted.select(
        *[c for c in counted.columns if c not in ("__signals", "__high")],
        *[F.col(f"{s}.{n}").alias(f"{n}_count") for n, s in source.items()],
        *[(F.col(f"{s}.{n}") > 0).alias(f"{n}_flag") for n, s in source.items()],
    )


def mention_counts(
    texts: DataFrame, vocabulary: DataFrame, key: Sequence[str], current: str = "package", text: str = "text"
) -> DataFrame:
    """(key, name, mentions) of every known package mentioned in a text, except its own.

    One plan serves any vocabulary: a bit filter of fixed size over the names travels to
    the texts and drops nearly all grams that are no name before anything is shuffled; a
    vocabulary too large for it lets more grams pass. The grams that pass are counted per
    text and joined with the names, which decides. ``vocabulary`` has a column ``name``.
    """
    names = vocabulary.select("name", F.lower("name").alias("gram")).distinct()
    about = names.agg(F.coalesce(F.max(F.size(F.split("gram", r"\."))), F.lit(1)).alias("__pieces"))
    grams = with_scalars(texts, about).select(
        *key, F.col(current).alias("__own"), F.explode(mention_grams(F.col(text), F.col("__pieces"))).alias("gram")
    )
    slot = F.xxhash64("gram").bitwiseAND(F.lit(FILTER_WORDS * 64 - 1))
    word = F.shiftright(slot, 6)
    bit = slot.bitwiseAND(F.lit(63)).cast("int")
    words = names.groupBy(word.alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("bits")
    )
    dense = texts.sparkSession.range(FILTER_WORDS).join(words, "id", "left")
    filled = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))
    # One row of FILTER_WORDS numbers, whatever the vocabulary.
    known = dense.agg(F.transform(filled, lambda x: x["bits"]).alias("__words"))
    passing = grams.join(F.broadcast(known), F.getbit(F.get("__words", word.cast("int")), bit) == 1)
    counted = passing.groupBy(*key, "__own", "gram").agg(F.count(F.lit(1)).alias("mentions"))
    return counted.join(names, "gram").filter(F.col("name") != F.col("__own")).select(*key, "name", "mentions")


def package_mentions(
    texts: DataFrame, vocabulary: DataFrame, key: Sequence[str], current: str = "package", text: str = "text"
) -> DataFrame:
    """One row per text with a map of mention counts (at most one entry per known package)."""
    counts = mention_counts(texts, vocabulary, key, current, text)
    maps = counts.groupBy(*key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "mentions")))).alias(
            "package_mentions"
        )
    )
    return texts.select(*key).join(maps, list(key), "left").withColumn(
        "package_mentions",
        F.coalesce("package_mentions", F.create_map().cast("map<string,bigint>")),
    )


def signal_reproduction(
    stored: DataFrame, recomputed: DataFrame, key: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """(key, field, stored, recomputed) where a stored signal is not reproduced."""

    def unpivot(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            *key,
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name))
                        for f in fields
                    ]
                )
            ).alias("x"),
        ).select(*key, "x.*")

    joined = unpivot(stored, "stored").join(
        unpivot(recomputed, "recomputed"), [*key, "field"], "full_outer"
    )
    return joined.filter(~F.col("stored").eqNullSafe(F.col("recomputed")))


def embedding_problems(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Violations of a vector table: repeated key, mixed width, mixed model, bad vector."""
    per_key = embeddings.groupBy("package", "version").agg(F.count(F.lit(1)).alias("n"))
    repeated = explode_rules(
        per_key, F.concat_ws("==", "package", "version"), {"duplicate_release": F.col("n") > 1}
    )
    spread = embeddings.agg(
        F.min(F.size(vector)).alias("w0"),
        F.max(F.size(vector)).alias("w1"),
        F.min("model").alias("m0"),
        F.max("model").alias("m1"),
    )
    mixed = explode_rules(
        spread,
        F.lit("table"),
        {"mixed_width": F.col("w0") != F.col("w1"), "mixed_model": F.col("m0") != F.col("m1")},
    )
    bad = explode_rules(
        embeddings,
        F.concat_ws("==", "package", "version"),
        {"invalid_vector": l2_normalize(F.col(vector))["violation"].isNotNull()},
    )
    return repeated.unionByName(mixed).unionByName(bad)


def reuse_embeddings(evidence: DataFrame, existing: DataFrame, done: DataFrame, model: str) -> DataFrame:
    """Existing vectors whose release, text hash and model still match and that are not done yet."""
    key = ["package", "version"]
    wanted = evidence.select(*key, "selected_text_sha256")
    return (
        existing.filter(F.col("model") == model)
        .join(wanted, [*key, "selected_text_sha256"], "left_semi")
        .join(done.select(*key), key, "left_anti")
    )


def resume_guard(existing: DataFrame, source: DataFrame, model: str, width: int) -> DataFrame:
    """Violations of stored vectors against the evidence they were made from."""
    texts = source.select(
        "package", "version", F.col("selected_text_sha256").alias("__hash"), F.lit(True).alias("__s")
    )
    joined = existing.join(texts, ["package", "version"], "left")
    return explode_rules(
        joined,
        F.concat_ws("==", "package", "version"),
        {
            "not_in_source": F.col("__s").isNull(),
            "text_changed": F.col("__hash") != F.col("selected_text_sha256"),
            "other_model": ~F.coalesce(F.col("model") == model, F.lit(False)),
            "other_width": F.size("embedding") != width,
        },
    )


Encoder = Callable[[list[list[str]]], np.ndarray]


def hashing_encoder(width: int) -> Encoder:
    """Offline default: token counts hashed into ``width`` signed cells."""
    import zlib

    def encode(chunks: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(chunks), width))
        for i, tokens in enumerate(chunks):
            for token in tokens:
                code = zlib.crc32(token.encode("utf-8"))
                out[i, code % width] += 1.0 if (code >> 31) else -1.0
            out[i] /= max(1, len(tokens))
        return out

    return encode


def embed_texts(
    df: DataFrame,
    key: Sequence[str],
    encoder: Encoder,
    payload: int = 510,
    max_chunks: int | None = None,
    text: str = "text",
) -> DataFrame:
    """(key, embedding, violation): the mean of the chunk vectors, scaled to unit length.

    All chunks of a text are encoded; ``max_chunks`` asks for so many evenly spread
    ones instead. A null text or one without tokens stays, with a null vector and a
    violation. Chunk offsets are planned by Spark; only the encoder runs in Python, one
    Arrow batch of chunks at a time. Chunks of one text may run in different
    tasks, their vectors are averaged by an aggregation.
    """
    tokens = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda t: t != "")
    chunks = (
        df.select(*key, tokens.alias("tokens"))
        .filter(F.size("tokens") > 0)
        .select(
            *key,
            "tokens",
            F.explode(
                chunk_starts(F.size("tokens"), payload, F.size("tokens") if max_chunks is None else max_chunks)
            ).alias("start"),
        )
        .select(*key, F.slice("tokens", F.col("start") + 1, F.lit(payload)).alias("chunk"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = encoder([list(c) for c in batch["chunk"]])
            yield batch[list(key)].assign(vector=list(vectors))

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"{k} {types[k]}" for k in key], "vector array<double>"])
    encoded = chunks.mapInPandas(run, schema)
    mean = encoded.groupBy(*key).agg(
        Summarizer.mean(array_to_vector(F.col("vector"))).alias("v")
    )
    unit = l2_normalize(vector_to_array("v"))
    made = mean.select(*key, unit["vector"].alias("embedding"), unit["violation"].alias("violation"))
    none = F.coalesce(F.size(tokens), F.lit(0)) <= 0
    empty = df.filter(none).select(
        *key, F.lit(None).cast("array<double>").alias("embedding"), F.lit("text has no tokens").alias("violation")
    )
    return made.unionByName(empty)
