"""Package names, pins and deterministic row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pinlattice.constants import CATALOG_ID_SUFFIX, CHANGELOG_ID_SUFFIX


def canonical_name(name: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(name, r"[-_.]+", "-")))


def parse_pin(pin: Column) -> Column:
    """``name==version`` -> struct(name, version); null unless both parts are non-empty."""
    parts = F.split(pin, "==", 2)
    name, version = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    return F.when(
        (F.length(name) > 0) & (F.length(version) > 0),
        F.struct(name.alias("name"), version.alias("version")),
    )


def _short_digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def experiment_id(
    name_a: Column,
    version_a: Column,
    name_b: Column,
    version_b: Column,
    python_version: Column,
    os: Column | None = None,
    architecture: Column | None = None,
) -> Column:
    """Order-sensitive key: swapping the two packages gives another experiment."""
    parts = (
        F.lower(name_a),
        version_a,
        F.lower(name_b),
        version_b,
        python_version,
        F.lit("linux") if os is None else os,
        F.lit("x86_64") if architecture is None else architecture,
    )
    # concat_ws skips nulls, which would let two different specs share a key.
    known = F.lit(True)
    for part in parts:
        known = known & part.isNotNull()
    return F.when(known, _short_digest(*parts))


def catalog_id(package: Column, version: Column, python_version: Column) -> Column:
    return _short_digest(F.lower(package), version, python_version, F.lit(CATALOG_ID_SUFFIX))


def changelog_id(package: Column, version: Column) -> Column:
    return _short_digest(F.lower(package), version, F.lit(CHANGELOG_ID_SUFFIX))


def environment_key(pins: Column) -> Column:
    """Digest of an array<struct<name, version>>, independent of pin order."""
    lines = F.transform(
        pins, lambda p: F.concat(canonical_name(p["name"]), F.lit("=="), p["version"])
    )
    return F.sha2(F.array_join(F.array_sort(lines), "\n"), 256)


def unordered_pair(left: Column, right: Column) -> tuple[Column, Column]:
    return F.least(left, right), F.greatest(left, right)
