"""Version text as orderable Columns.

Arrays and structs compare lexicographically in Spark, so a version becomes a
sort key made of integers and no per-row Python is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pinlattice.constants import NOTE_VERSION, STABLE_VERSION
from pinlattice.functions.binding import let

STABLE = STABLE_VERSION
# Public version grammar of PEP 440, appendix B, in lower case.
PEP440 = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
_FAR = 9223372036854775807


def _group(version: Column, index: int) -> Column:
    return F.nullif(F.regexp_extract(version, PEP440, index), F.lit(""))


def _long(text: Column) -> Column:
    return text.try_cast("bigint")


def is_stable(version: Column) -> Column:
    """Two to four numeric parts and an optional post release."""
    return version.rlike(STABLE)


def version_key(version: Column) -> Column:
    """struct(release, post) for stable versions, null for anything else."""
    release = F.transform(F.split(F.regexp_extract(version, r"^([0-9.]*[0-9])", 1), r"\."), _long)
    post = F.coalesce(_long(F.regexp_extract(version, r"\.post([0-9]+)$", 1)), F.lit(-1))
    return F.when(is_stable(version), F.struct(release.alias("release"), post.alias("post")))


def is_pep440(version: Column) -> Column:
    return F.lower(version).rlike(PEP440)


def pep440_stable(version: Column) -> Column:
    """Valid, neither a pre-release nor a development release."""
    v = F.lower(version)
    return F.coalesce(
        v.rlike(PEP440) & _group(v, 3).isNull() & _group(v, 8).isNull(), F.lit(False)
    )


def release_parts(version: Column) -> Column:
    """Integer release segment as array<bigint>; null when the text is no version."""
    v = F.lower(version)
    return F.when(v.rlike(PEP440), F.transform(F.split(_group(v, 2), r"\."), _long))


def strip_trailing_zeros(parts: Column) -> Column:
    last = F.array_max(
        F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(F.lit(1)))
    )
    return F.slice(parts, 1, last)


def pep440_key(version: Column) -> Column:
    """Total order of PEP 440 as one orderable struct, null for invalid text."""
    return let(F.lower(version), lambda v: F.when(v.rlike(PEP440), let(_groups(v), _key_of)))


def _groups(v: Column) -> Column:
    names = ("epoch", "release", "pre", "pre_n", "dash", "post", "post_n", "dev", "dev_n", "local")
    return F.struct(*[_group(v, i).alias(n) for i, n in enumerate(names, 1)])


def _key_of(g: Column) -> Column:
    zero = F.lit(0).cast("bigint")

    def number(text: Column) -> Column:
        return F.coalesce(_long(text), zero)

    post = F.coalesce(_long(g["dash"]), F.when(g["post"].isNotNull(), number(g["post_n"])))
    phase = (
        F.when(g["pre"].isin("a", "alpha"), 0)
        .when(g["pre"].isin("b", "beta"), 1)
        .when(g["pre"].isNotNull(), 2)
        .when(post.isNull() & g["dev"].isNotNull(), -1)
        .otherwise(3)
    )
    local = F.transform(
        F.split(F.coalesce(g["local"], F.lit("")), r"[-_.]"),
        lambda s: F.struct(
            F.when(s == "", -1).when(s.rlike(r"^\d+$"), 1).otherwise(0).alias("kind"),
            number(s).alias("number"),
            F.when(s.rlike(r"^\d+$"), F.lit("")).otherwise(s).alias("text"),
        ),
    )
    release = let(F.transform(F.split(g["release"], r"\."), _long), strip_trailing_zeros)
    return F.struct(
        number(g["epoch"]).alias("epoch"),
        release.alias("release"),
        phase.alias("phase"),
        number(g["pre_n"]).alias("pre"),
        F.coalesce(post, F.lit(-1)).alias("post"),
        F.when(g["dev"].isNotNull(), number(g["dev_n"])).otherwise(F.lit(_FAR)).alias("dev"),
        local.alias("local"),
    )


def history_key(version: Column) -> Column:
    """Valid versions first in PEP 440 order, then the remaining texts alphabetically."""
    return let(
        pep440_key(version),
        lambda key: F.struct(
            F.when(key.isNull(), 1).otherwise(0).alias("kind"),
            key.alias("key"),
            F.when(key.isNull(), version).alias("text"),
        ),
    )


def version_parts(version: Column) -> Column:
    """First three integers found anywhere in the text, null padded."""
    numbers = F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1))
    return F.struct(
        _long(F.get(numbers, F.lit(0))).alias("major"),
        _long(F.get(numbers, F.lit(1))).alias("minor"),
        _long(F.get(numbers, F.lit(2))).alias("patch"),
    )


def padded_release(version: Column, width: int) -> Column:
    """First ``width`` integers found in the text, zero padded."""
    zero = F.lit(0).cast("bigint")
    return let(
        F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)),
        lambda numbers: F.array(
            *[F.coalesce(_long(F.get(numbers, F.lit(i))), zero) for i in range(width)]
        ),
    )


def release_triple(version: Column) -> Column:
    """First three release numbers of a valid version, zeros otherwise."""
    zero = F.lit(0).cast("bigint")
    return let(
        release_parts(version),
        lambda parts: F.array(*[F.coalesce(F.get(parts, F.lit(i)), zero) for i in range(3)]),
    )


def triple_distance(a: Column, b: Column) -> Column:
    """Weighted distance of two release triples."""
    return (
        F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0))) * 1_000_000
        + F.abs(F.get(a, F.lit(1)) - F.get(b, F.lit(1))) * 1_000
        + F.abs(F.get(a, F.lit(2)) - F.get(b, F.lit(2)))
    )


def version_distance(left: Column, right: Column) -> Column:
    return let(
        F.struct(release_triple(left).alias("a"), release_triple(right).alias("b")),
        lambda x: triple_distance(x["a"], x["b"]),
    )


def note_version(version: Column) -> Column:
    """Leading major.minor[.patch] as array<bigint>, patch 0 when absent; null if missing."""
    pattern = NOTE_VERSION
    return F.when(
        version.rlike(pattern),
        F.array(
            *[
                F.coalesce(_long(F.regexp_extract(version, pattern, i)), F.lit(0))
                for i in (1, 2, 3)
            ]
        ),
    )
