"""Filter interaction audit on failing-id relations.

Every filter stores the keys of the documents it fails as a table of its own. The
survivors of all prefixes are one relation (prefix, document): filter by filter,
each row is repeated with the filter added to its prefix, and a left-anti join with
the filter's key table takes out the failing rows whose prefix holds the filter. What
a filter removes after a prefix is a left-semi join of the prefix's survivors with its
key table. Which documents survive does not depend on the order inside a prefix, so n
filters need 2 ** n prefixes for all n! orders, and n joins of each kind. All relations
are narrow (two hashes, a part, two flags), texts are read once.

Defined results: a null text counts as empty, a null part as the empty string. Rows
equal in id, text and part share their fate and are counted each. A null id is neither
smaller nor greater than another, so it never fails filter E. A document without a label
is neither good nor toxic; of several labels one with the value suffices. Without
documents there are no parts and no rows. Extra columns are not read. Texts and ids are
compared by 128 bits of hashes.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pinlattice.llm.stored import look_up, stored

KEY = ["k1", "k2"]
MIN_WORDS = 200
_SPACE = "[\\x20\\x09-\\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that look at one text."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n_words = F.size(words).cast("long")
    return {
        "A": n_words < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n_words,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One narrow row per document: its key, id, text hashes, part and failures A to D."""
    body = F.coalesce(docs[text], F.lit(""))
    # Any id starts with a sign, so a null id is no other id.
    name = F.coalesce(F.concat(F.lit("="), docs[doc_id].cast("string")), F.lit(""))
    rows = docs.select(
        docs[doc_id].alias("id"),
        F.xxhash64(name, body).alias("k1"),
        F.xxhash64(F.lit(1), name, body).alias("k2"),
        F.xxhash64(body).alias("h1"),
        F.xxhash64(F.lit(1), body).alias("h2"),
        F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        *[c.alias(f) for f, c in text_failures(body).items()],
    )
    return stored(rows, "described")


def copied(rows: DataFrame) -> DataFrame:
    """The keys of documents whose text a smaller id has too."""
    least = rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter(F.col("least") < F.col("most"))
    return look_up(rows.select(*KEY, "id", "h1", "h2"), stored(least.drop("most"), "least"), ["h1", "h2"]).filter(F.col("id") > F.col("least"))


def failing_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """One stored table of distinct keys per filter."""
    failing = {f: rows.filter(F.col(f)) for f in "ABCD"} | {"E": copied(rows)}
    return {f: stored(df.select(*KEY).distinct(), f"fails-{f}") for f, df in failing.items()}


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Distinct documents with their number of rows and whether they are good and toxic."""

    def any_one(c: str) -> Column:
        return F.max(F.coalesce(F.col(c) == 1, F.lit(False)))

    known = labels.groupBy(labels[doc_id].alias("id")).agg(any_one("quality").alias("good"), any_one("toxic").alias("toxic")).dropna(subset=["id"])
    grouped = stored(rows.groupBy(*KEY, "id", "part").agg(F.count(F.lit(1)).alias("n")), "distinct")
    found = look_up(grouped, known, ["id"])
    return stored(
        found.select(
            *KEY,
            "part",
            "n",
            F.when(F.col("good"), F.col("n")).otherwise(0).alias("good"),
            F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("toxic"),
        ),
        "labelled",
    )


def _holds(prefix: Column, bit: int) -> Column:
    return prefix.bitwiseAND(F.lit(bit)) != 0


def _same_key(left: DataFrame, right: DataFrame) -> Column:
    return (left["k1"] == right["f1"]) & (left["k2"] == right["f2"])


def survivors(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """``rows`` once per prefix they survive; ``prefix`` has bit i for the i-th filter."""
    out = rows.withColumn("prefix", F.lit(0))
    for i, ids in enumerate(failing.values()):
        ids = ids.toDF("f1", "f2")
        prefix = F.col("prefix")
        both = out.withColumn("prefix", F.explode(F.array(prefix, prefix.bitwiseOR(F.lit(1 << i)))))
        out = both.join(ids, _same_key(both, ids) & _holds(both["prefix"], 1 << i), "left_anti")
    return out


def audit(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """Every order of the filters, step by step, per part.

    ``rows`` has ``k1 k2 part n good toxic`` (numbers of rows), ``failing`` maps filters of
    one letter, in order, to tables of the keys they fail. At most six filters: a part's
    results are one row while its orders are written out.
    """
    letters = list(failing)
    if len(letters) > 6:
        raise ValueError("more than six filters have too many orders to list")
    alive = survivors(rows, failing)
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    # Code: the prefix, and behind it the filter applied next (0: none, only survivors).
    cells = alive.groupBy("part", (F.col("prefix") * 8).alias("code")).agg(*sums)
    for i, ids in enumerate(failing.values()):
        ids = ids.toDF("f1", "f2")
        open_rows = alive.filter(~_holds(F.col("prefix"), 1 << i))
        removed = open_rows.join(ids, _same_key(open_rows, ids), "left_semi")
        cells = cells.unionByName(removed.groupBy("part", (F.col("prefix") * 8 + (i + 1)).alias("code")).agg(*sums))
    facts = F.map_from_entries(F.collect_list(F.struct("code", F.struct("n", "good", "toxic"))))
    # One row per part with 2 ** n prefixes and n * 2 ** (n - 1) removals.
    parts = rows.select("part").distinct().join(cells.groupBy("part").agg(facts.alias("facts")), "part", "left")

    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = parts.select("part", "facts", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    own = F.expr("substring(filter_order, step, 1)")
    before = F.expr("substring(filter_order, 1, step - 1)")
    bits = [F.when(F.instr(before, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(letters)]
    number = F.instr(F.lit("".join(letters)), own)
    steps = steps.select("*", own.alias("filter"), number.alias("i"), sum(bits[1:], bits[0]).alias("before"))
    bit = F.expr("shiftleft(1, i - 1)")

    def cell(prefix: Column, applied: Column | int, value: str = "n") -> Column:
        return F.coalesce(F.try_element_at(F.col("facts"), prefix * 8 + applied)[value], F.lit(0)).cast("long")

    i, prefix = F.col("i"), F.col("before")
    out = steps.select(
        "part",
        "filter_order",
        "step",
        "filter",
        cell(prefix + bit, 0).alias("kept"),
        cell(prefix, i).alias("removed"),
        (cell(F.lit(0), i) - cell(prefix, i)).alias("redundant"),
        cell(F.lit((1 << len(letters)) - 1) - bit, i).alias("unique_fails"),
        cell(prefix, i, "good").alias("good_lost"),
        cell(prefix, i, "toxic").alias("toxic_lost"),
    )
    # n! orders of one filter and part.
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))


def audit_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The five corpus filters on ``docs`` in all 120 orders."""
    rows = described(docs, doc_id, text, part)
    return audit(labelled(rows, labels, doc_id), failing_tables(rows))
