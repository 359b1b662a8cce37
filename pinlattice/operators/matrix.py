"""Experiment matrix: product inside families, coverage, order, shards and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinlattice.constants import SPLITS
from pinlattice.functions.names import experiment_id, unordered_pair
from pinlattice.operators.ordered import attach, ordered, with_scalars
from pinlattice.operators.skew import spread_join
from pinlattice.operators.violations import explode_rules, union_all, violation

SCOPE_COLUMNS = ("package", "version", "python_version", "eligible", "reason", "version_order")


def experiment_matrix(scope: DataFrame, families: DataFrame, runnable_only: bool = False) -> DataFrame:
    """families x versions of A x versions of B x Python targets.

    ``scope`` holds one row per (package, version, python_version) with eligible,
    reason and version_order. With ``runnable_only`` uncovered releases are
    dropped before the product instead of after it.
    """
    scope = scope.select(*SCOPE_COLUMNS)
    if runnable_only:
        scope = scope.filter("eligible")

    def side(s: str) -> DataFrame:
        return scope.select(
            F.col("package").alias(f"package_{s}"),
            F.col("version").alias(f"version_{s}"),
            "python_version",
            F.col("eligible").alias(f"eligible_{s}"),
            F.col("reason").alias(f"reason_{s}"),
            F.col("version_order").alias(f"order_{s}"),
        )

    left = families.select("family", "package_a", "package_b").join(side("a"), "package_a")
    product = spread_join(left, side("b"), ["package_b", "python_version"])
    return _matrix_rows(product)


def _matrix_rows(product: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    return product.select(
        experiment_id(
            F.col("package_a"),
            F.col("version_a"),
            F.col("package_b"),
            F.col("version_b"),
            F.col("python_version"),
        ).alias("experiment_id"),
        "family",
        "package_a",
        "version_a",
        "package_b",
        "version_b",
        "python_version",
        (F.col("eligible_a") & F.col("eligible_b")).alias("eligible"),
        "reason_a",
        "reason_b",
        "order_a",
        "order_b",
        *extra,
    )


def numbered_matrix(scope: DataFrame, families: DataFrame, runnable_only: bool = False) -> DataFrame:
    """``experiment_matrix`` with ``matrix_order``, numbered without sorting the product.

    A row's number is a mixed-radix one: what the blocks (family, Python target) before it hold, plus
    its place in the block, (rank of A - 1) * versions of B + rank of B. Ranks follow version_order,
    then version. Only the scope and the blocks are ordered; the product itself is never shuffled
    by its order.
    """
    scope = scope.select(*SCOPE_COLUMNS)
    if runnable_only:
        scope = scope.filter("eligible")
    target = ["package", "python_version"]
    ranked = ordered(scope, [F.col("version_order"), F.col("version")], target, position="__rank", group_size="__n")
    counts = ranked.select(*target, "__n").distinct()

    def counts_of(s: str) -> DataFrame:
        return counts.select(F.col("package").alias(f"package_{s}"), "python_version", F.col("__n").alias(f"__n_{s}"))

    blocks = families.select("family", "package_a", "package_b").join(counts_of("a"), "package_a").join(counts_of("b"), ["package_b", "python_version"])
    blocks = blocks.withColumn("__size", F.col("__n_a") * F.col("__n_b"))
    place = [F.col("family"), python_order(), F.col("package_a"), F.col("package_b")]
    blocks = ordered(blocks, place, position=None, totals={"__upto": "__size"})

    def side(s: str) -> DataFrame:
        return ranked.select(
            F.col("package").alias(f"package_{s}"),
            F.col("version").alias(f"version_{s}"),
            "python_version",
            F.col("eligible").alias(f"eligible_{s}"),
            F.col("reason").alias(f"reason_{s}"),
            F.col("version_order").alias(f"order_{s}"),
            F.col("__rank").alias(f"__rank_{s}"),
        )

    left = spread_join(blocks, side("a"), ["package_a", "python_version"])
    product = spread_join(left, side("b"), ["package_b", "python_version"])
    number = F.col("__upto") - F.col("__size") + (F.col("__rank_a") - 1) * F.col("__n_b") + F.col("__rank_b")
    return _matrix_rows(product, [number.alias("matrix_order")])


def matrix_counts(scope: DataFrame, families: DataFrame) -> DataFrame:
    """(family, python_version, eligible, reason_a, reason_b, rows) of the matrix, from counts of the scope alone."""
    per_reason = scope.groupBy("package", "python_version", "eligible", "reason").agg(F.count(F.lit(1)).alias("n"))

    def side(s: str) -> DataFrame:
        return per_reason.select(
            F.col("package").alias(f"package_{s}"), "python_version", F.col("eligible").alias(f"eligible_{s}"), F.col("reason").alias(f"reason_{s}"), F.col("n").alias(f"n_{s}")
        )

    pairs = families.select("family", "package_a", "package_b").join(side("a"), "package_a").join(side("b"), ["package_b", "python_version"])
    keys = ["family", "python_version", (F.col("eligible_a") & F.col("eligible_b")).alias("eligible"), "reason_a", "reason_b"]
    return pairs.groupBy(*keys).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("rows"))


def split_coverage(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runnable rows, exclusions with the reason of both sides)."""
    return matrix.filter("eligible"), matrix.filter(~F.col("eligible"))


def python_order(version: str = "python_version"):
    """Numeric order of a Python version, so that 3.9 comes before 3.10."""
    return F.transform(F.split(F.col(version), r"\."), lambda p: p.try_cast("int"))


def matrix_order(matrix: DataFrame) -> DataFrame:
    """1-based order by family, Python target and the listed order of both versions."""
    return ordered(
        matrix,
        [F.col("family"), python_order(), F.col("order_a"), F.col("order_b"), F.col("experiment_id")],
        position="matrix_order",
    )


def assign_shards(df: DataFrame, size: int, position: str = "matrix_order") -> DataFrame:
    """Contiguous shards of ``size`` rows: shard_index, shard_count and shard_name."""
    counted = with_scalars(
        df, df.agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("shard_count"))
    )
    index = (F.floor((F.col(position) - 1) / size) + 1).cast("int")
    width = F.greatest(F.lit(2), F.length(F.col("shard_count").cast("string")))

    def padded(column):
        text = column.cast("string")
        return F.concat(F.repeat(F.lit("0"), width - F.length(text)), text)

    return counted.withColumn("shard_index", index).withColumn(
        "shard_name",
        F.concat(
            F.lit("shard-"), padded(F.col("shard_index")), F.lit("-of-"), padded(F.col("shard_count"))
        ),
    )


def shard_summary(sharded: DataFrame) -> DataFrame:
    per_shard = sharded.groupBy("shard_index").agg(F.count(F.lit(1)).alias("n"))
    return per_shard.agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("n").alias("rows"),
        F.min_by("n", "shard_index").alias("first_size"),
        F.max_by("n", "shard_index").alias("last_size"),
    )


def matrix_reconcile(scope: DataFrame, families: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """Per family: candidates, runnable and excluded rows, and whether they agree.

    The counts follow from the scope. Where a stored ``matrix`` is given, its rows are counted
    instead and compared with the candidates that the scope allows.
    """
    per_target = scope.groupBy("package", "python_version").agg(F.count(F.lit(1)).alias("n"))
    a = per_target.select(
        F.col("package").alias("package_a"), "python_version", F.col("n").alias("n_a")
    )
    b = per_target.select(
        F.col("package").alias("package_b"), "python_version", F.col("n").alias("n_b")
    )
    expected = (
        families.join(a, "package_a")
        .join(b, ["package_b", "python_version"])
        .groupBy("family")
        .agg(F.sum(F.col("n_a") * F.col("n_b")).alias("expected"))
    )
    counted = matrix_counts(scope, families) if matrix is None else matrix.withColumn("rows", F.lit(1))
    actual = counted.groupBy("family").agg(
        F.sum(F.when(F.col("eligible"), F.col("rows"))).alias("runnable"),
        F.sum(F.when(~F.col("eligible"), F.col("rows"))).alias("excluded"),
    )
    zero = F.lit(0)
    return expected.join(actual, "family", "full_outer").select(
        "family",
        F.coalesce("expected", zero).alias("expected"),
        F.coalesce("runnable", zero).alias("runnable"),
        F.coalesce("excluded", zero).alias("excluded"),
        (
            F.coalesce("expected", zero)
            == F.coalesce("runnable", zero) + F.coalesce("excluded", zero)
        ).alias("reconciled"),
    )


def exclusion_reasons(counts: DataFrame) -> DataFrame:
    """Reasons of excluded rows per side, from ``matrix_counts``."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"reason_{s}").alias("reason")) for s in ("a", "b")])
    return (
        counts.filter(~F.col("eligible"))
        .select("rows", F.explode(sides).alias("x"))
        .select("x.side", "x.reason", "rows")
        .filter(F.col("reason") != "eligible")
        .groupBy("side", "reason")
        .agg(F.sum("rows").alias("rows"))
    )


def split_disjoint(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split."""
    return (
        df.groupBy(key)
        .agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"))
        .filter(F.col("first_split") != F.col("last_split"))
    )


def runtime_pilot(scope: DataFrame, families: DataFrame, package_a: str, package_b: str, pythons: DataFrame) -> DataFrame:
    """One row per Python target for one pair; a target without rows has a null id.

    Only the pair's own rows are built: the newest runnable version of each side per target.
    """
    pair = families.filter((F.col("package_a") == package_a) & (F.col("package_b") == package_b))
    newest = scope.filter(F.col("package").isin(package_a, package_b) & F.col("eligible")).groupBy("package", "python_version").agg(
        F.max_by(F.struct(*SCOPE_COLUMNS), "version_order").alias("x")
    )
    rows = experiment_matrix(newest.select("x.*"), pair).groupBy("python_version").agg(
        F.max(F.struct("experiment_id", "version_a", "version_b")).alias("row")
    )
    return pythons.join(rows, "python_version", "left").select(
        "python_version",
        "row.experiment_id",
        "row.version_a",
        "row.version_b",
        F.col("row").isNull().alias("missing"),
    )


def scope_bounds(plan: DataFrame, scope: DataFrame) -> DataFrame:
    """Packages whose number of selected versions leaves [minimum, target] or is unplanned.

    plan: package, minimum_versions, target_versions; scope: package, version.
    """
    counts = scope.groupBy("package").agg(F.count_distinct("version").alias("selected"))
    joined = plan.join(counts, "package", "full_outer")
    return explode_rules(
        joined,
        F.col("package"),
        {
            "not_in_plan": F.col("target_versions").isNull(),
            "not_in_scope": F.col("selected").isNull(),
            "too_few_versions": F.col("selected") < F.col("minimum_versions"),
            "too_many_versions": F.col("selected") > F.col("target_versions"),
        },
    )


def split_summary(packages: DataFrame, families: DataFrame, target_versions: int, pythons: int) -> DataFrame:
    """Per split: packages, families, largest possible product and its 70-90 % range."""
    p = packages.groupBy("split").agg(F.count(F.lit(1)).alias("packages"))
    f = families.groupBy("split").agg(F.count(F.lit(1)).alias("families"))
    most = F.col("families") * target_versions * target_versions * pythons
    return attach(p, f, ["split"], "left").select(
        "split",
        "packages",
        F.coalesce("families", F.lit(0)).alias("families"),
        F.coalesce(most, F.lit(0)).alias("maximum_experiments"),
        F.coalesce(F.floor(most * 0.7), F.lit(0)).alias("estimate_low"),
        F.coalesce(F.floor(most * 0.9), F.lit(0)).alias("estimate_high"),
    )


def _repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def validate_plan(packages: DataFrame, families: DataFrame, default_minimum: int, target: int) -> DataFrame:
    """Rule violations of a dataset plan.

    packages: package, role, split, minimum_versions; families: family, package_a,
    package_b, split.
    """
    minimum = F.coalesce("minimum_versions", F.lit(default_minimum))
    known_split = F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    package_rules = explode_rules(
        packages,
        F.col("package"),
        {
            "invalid_split": ~known_split,
            "missing_role": F.trim(F.coalesce("role", F.lit(""))) == "",
            "minimum_versions": (minimum < 2) | (minimum > target),
        },
    )
    lo, hi = unordered_pair(F.col("package_a"), F.col("package_b"))
    splits = packages.select("package", F.col("split").alias("__split"))

    def side(s: str) -> DataFrame:
        return splits.select(
            F.col("package").alias(f"package_{s}"), F.col("__split").alias(f"split_{s}")
        )

    placed = families.join(side("a"), "package_a", "left").join(side("b"), "package_b", "left")
    family_rules = explode_rules(
        placed,
        F.col("family"),
        {
            "missing_name": F.trim(F.coalesce("family", F.lit(""))) == "",
            "unknown_package": F.col("split_a").isNull() | F.col("split_b").isNull(),
            "same_package": F.col("package_a") == F.col("package_b"),
            "family_split": ~known_split,
            "crosses_splits": (F.col("split_a") != F.col("split"))
            | (F.col("split_b") != F.col("split")),
        },
    )
    pairs = families.select("family", lo.alias("lo"), hi.alias("hi"))
    used = families.select(F.explode(F.array("package_a", "package_b")).alias("package"))
    return union_all(
        [
            package_rules,
            family_rules,
            violation(_repeated(families, ["family"]), "duplicate_family", F.col("family")),
            violation(
                _repeated(pairs, ["lo", "hi"]),
                "duplicate_pair",
                F.concat_ws("|", "lo", "hi"),
            ),
            violation(
                packages.join(used, "package", "left_anti"), "unused_package", F.col("package")
            ),
        ]
    )
