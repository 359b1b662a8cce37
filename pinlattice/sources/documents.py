"""One large JSON document, read and written by many tasks.

A document is an object whose members are plain values or sections; a section is an
object or a list of objects, the records::

    {"coverage_order": ["3.11"], "packages": {"alpha": {...}, "beta": {...}}, "families": [{...}, {...}]}

Spark cuts the file at every closing brace, so each byte range is a task of its own.
Whether a brace closes a record depends on all text before it: a split is therefore
summed up twice, as if it began inside and outside a string, and the summaries (one row
per split) decide which of the two holds. A folder is read as the concatenation of its
files in name order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinlattice.operators.ordered import ordered, with_scalars

MEMBERS = "map<string,string>"
_SPLIT = ["file", "block"]
_SIMPLE = r'(?s)^\s*,\s*(?:("[^"\\]*+(?:\\.[^"\\]*+)*+")\s*:\s*)?(\{.*)$'
_AFTER_SECTION = r"^\s*[\]}]\s*,?"


def _rise(outside: Column) -> Column:
    """Brackets opened less brackets closed; the closing braces are the cuts themselves."""
    opened = F.length(outside) - F.length(F.translate(outside, "{[", ""))
    return opened - (F.length(outside) - F.length(F.translate(outside, "]", "")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value, size, odd, rise_out, rise_in): one row per closing brace.

    ``odd`` says that the piece holds an odd number of string quotes; the rises are
    those of a piece that begins outside or inside a string, its closing brace included.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    odd = (F.length(bare) - F.length(F.translate(bare, '"', ""))) % 2
    strings = r'"[^"]*(?:"|\z)'
    return raw.select(
        "*",
        odd.alias("odd"),
        (_rise(F.regexp_replace(bare, strings, "")) - (1 - odd)).alias("rise_out"),
        (_rise(F.regexp_replace(F.concat(F.lit('"'), bare), strings, "")) - odd).alias("rise_in"),
    )


def _placed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pieces with ``record`` (records closed before them), ``closes`` and ``open``; and one row ``whole``."""
    in_split = W.partitionBy(*_SPLIT).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = _pieces(spark, path).withColumn("quotes", F.sum("odd").over(in_split))
    inside = (F.col("quotes") - F.col("odd")) % 2 == 1
    rows = rows.withColumn("r0", F.when(inside, F.col("rise_in")).otherwise(F.col("rise_out"))).withColumn(
        "r1", F.when(inside, F.col("rise_out")).otherwise(F.col("rise_in"))
    )

    # One row per split from here to the offsets. The last piece of a file has no brace of
    # its own where the bytes of the pieces and their braces are one more than the file's.
    splits = rows.groupBy(*_SPLIT).agg(
        (F.sum("odd") % 2).alias("parity"),
        F.sum("r0").alias("t0"),
        F.sum("r1").alias("t1"),
        F.max("at").alias("last_at"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.max("size").alias("size"),
    )
    of_file = W.partitionBy("file")
    unclosed = (F.sum("bytes").over(of_file) > F.col("size")) & (F.col("block") == F.max("block").over(of_file))
    splits = splits.withColumn("unclosed", unclosed)
    splits = splits.withColumn(
        "t0", F.col("t0") + F.when(F.col("unclosed") & (F.col("parity") == 0), 1).otherwise(0)
    ).withColumn("t1", F.col("t1") + F.when(F.col("unclosed") & (F.col("parity") == 1), 1).otherwise(0))
    before = W.orderBy(*_SPLIT).rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("state", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    total = F.when(F.col("state") == 1, F.col("t1")).otherwise(F.col("t0"))
    splits = splits.withColumn("total", total).withColumn(
        "depth", F.coalesce(F.sum("total").over(before), F.lit(0))
    )
    whole = splits.agg(
        F.coalesce((F.sum("total") == 0) & (F.sum("parity") % 2 == 0), F.lit(False)).alias("whole")
    )

    starts = splits.select(
        *_SPLIT, "state", "depth", F.when(F.col("unclosed"), F.col("last_at")).alias("open_at")
    )
    rows = rows.join(starts, _SPLIT)
    outside = (F.col("state") + F.col("quotes")) % 2 == 0
    is_open = F.coalesce(F.col("at") == F.col("open_at"), F.lit(False))
    risen = F.when(F.col("state") == 1, F.sum("r1").over(in_split)).otherwise(F.sum("r0").over(in_split))
    closes = outside & ~is_open & (F.col("depth") + risen == 2)
    rows = rows.select(*_SPLIT, "at", "value", is_open.alias("open"), closes.cast("long").alias("closes"))
    ended = rows.groupBy(*_SPLIT).agg(F.sum("closes").alias("n"))
    ended = ended.select(*_SPLIT, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    rows = rows.join(ended, _SPLIT)
    record = F.col("earlier") + F.sum("closes").over(in_split) - F.col("closes")
    return rows.withColumn("record", record), whole


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(section, position, name, value, members): one row per record of a document.

    ``position`` counts from 0 within the section, ``name`` is null in a list, ``value``
    is the record's text and ``members`` holds the text of every other member of the
    document. A document that is cut short, or a section that holds anything but
    objects, fails the job. A document without records gives no row.
    """
    placed, whole = _placed(spark, path)
    text = F.concat("value", F.when(F.col("open"), F.lit("")).otherwise(F.lit("}")))
    parts = F.array_sort(F.collect_list(F.struct(*_SPLIT, "at", text.alias("text"))))
    texts = placed.groupBy("record").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        (F.max("closes") == 1).alias("is_record"),
    )

    # The text before the first record of a section, the first record, and what follows the
    # last one: a row per section. Closed by hand they are small documents themselves.
    first = F.col("record") == 0
    head = texts.filter(first | F.col("text").rlike(_AFTER_SECTION))
    body = F.when(first, F.col("text")).otherwise(
        F.concat(F.lit("{"), F.regexp_replace("text", _AFTER_SECTION, ""))
    )
    parsed = F.when(
        F.col("is_record"),
        F.coalesce(
            F.from_json(F.concat(body, F.lit("]}")), MEMBERS), F.from_json(F.concat(body, F.lit("}}")), MEMBERS)
        ),
    ).otherwise(F.from_json(body, MEMBERS))
    head = head.select("record", "is_record", parsed.alias("m"))
    section = F.when(F.col("is_record"), F.element_at(F.map_keys("m"), -1))
    opening = F.struct("record", section.alias("section"), F.element_at(F.map_values("m"), -1).alias("first"))
    other = F.map_filter("m", lambda k, _: section.isNull() | (k != section))
    about = head.agg(
        F.array_sort(F.collect_list(F.when(F.col("is_record"), opening))).alias("openings"),
        F.flatten(F.collect_list(F.map_entries(other))).alias("entries"),
        F.bool_and(F.col("m").isNotNull()).alias("parsed"),
    )
    sound = F.col("whole") & F.col("parsed")
    broken = F.raise_error(F.lit("not a whole JSON document of sections of objects"))
    about = about.join(F.broadcast(whole)).select(
        F.when(sound, F.col("openings")).otherwise(broken).alias("openings"),
        F.map_from_entries("entries").alias("members"),
    )

    rows = with_scalars(texts.filter("is_record"), about)
    rows = rows.withColumn(
        "of", F.element_at(F.filter("openings", lambda o: o["record"] <= F.col("record")), -1)
    )
    leads = F.col("of.record") == F.col("record")
    as_map = F.when(leads, F.from_json(F.col("of.first"), MEMBERS))
    as_list = F.when(leads, F.from_json(F.col("of.first"), "array<string>"))
    in_list = F.col("of.first").startswith("[")
    alone = F.when(in_list, F.size(as_list)).otherwise(F.size(as_map)) == 1
    follows = F.col("text").rlike(_SIMPLE)
    key = F.from_json(
        F.concat(F.lit('{"k":'), F.regexp_extract("text", _SIMPLE, 1), F.lit("}")), "struct<k:string>"
    )["k"]
    strange = F.raise_error(F.concat(F.lit("a section holds more than objects: "), F.col("of.section")))
    return rows.select(
        F.col("of.section").alias("section"),
        (F.col("record") - F.col("of.record")).alias("position"),
        F.when(in_list, F.lit(None).cast("string"))
        .when(leads, F.map_keys(as_map)[0])
        .otherwise(key)
        .alias("name"),
        F.when(leads & alone & in_list, as_list[0])
        .when(leads & alone, F.map_values(as_map)[0])
        .when(~leads & follows, F.regexp_extract("text", _SIMPLE, 2))
        .otherwise(strange.cast("string"))
        .alias("value"),
        "members",
    )


def write_document(
    spark: SparkSession,
    path: str,
    sections: Mapping[str, tuple[DataFrame, Sequence[str]]],
    members: Mapping[str, str] | None = None,
) -> str:
    """Write one document as the files of a folder, in parallel, in name order.

    A section is (rows, order): rows of a ``value`` column with the text of each record,
    with a ``name`` column where the section is an object; ``order`` names the unique
    columns that its records follow. ``members`` are texts of plain members.
    """
    last = 1 << 62
    frames = []
    marks = [(0, 0, "{" + ", ".join(f'"{k}": {v}' for k, v in (members or {}).items()))]
    for i, (section, (rows, order)) in enumerate(sections.items(), start=1):
        named = "name" in rows.columns
        comma = ", " if members or i > 1 else ""
        marks.append((i, 0, f'{comma}"{section}": ' + ("{" if named else "[")))
        marks.append((i, last, "}" if named else "]"))
        numbered = ordered(rows, [F.col(c) for c in order])
        text = F.col("value")
        if named:
            label = F.expr("substring(to_json(struct(name as k)), 6, length(to_json(struct(name as k))) - 6)")
            text = F.concat(label, F.lit(": "), text)
        text = F.concat(F.when(F.col("position") > 1, ",").otherwise(""), text)
        frames.append(numbered.select(F.lit(i).alias("rank"), F.col("position").cast("long"), text.alias("text")))
    marks.append((len(sections) + 1, 0, "}"))
    lines = spark.createDataFrame(marks, "rank int, position long, text string")
    for frame in frames:
        lines = lines.unionByName(frame)
    lines = lines.repartitionByRange("rank", "position").sortWithinPartitions("rank", "position")
    lines.select("text").write.text(path)
    return path
