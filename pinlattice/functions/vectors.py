"""Dense vectors held as array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pinlattice.functions.binding import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """struct(vector, violation): unit vector, or why there is none."""
    v = v.cast("array<double>")

    def scaled(length: Column) -> Column:
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        problem = F.when(~finite, "vector is not finite").when(length == 0, "vector is zero")
        return F.struct(
            F.when(problem.isNull(), F.transform(v, lambda x: x / length)).alias("vector"),
            problem.alias("violation"),
        )

    return let(norm(v), scaled)


def pair_interactions(a: Column, b: Column) -> Column:
    """[A, B, |A - B|, A * B]."""
    return F.concat(
        a,
        b,
        F.zip_with(a, b, lambda x, y: F.abs(x - y)),
        F.zip_with(a, b, lambda x, y: x * y),
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(x, F.lit(35.0)), F.lit(-35.0))))


def noisy_or(*probabilities: Column) -> Column:
    missing = F.lit(1.0)
    for p in probabilities:
        missing = missing * (F.lit(1.0) - p)
    return F.lit(1.0) - missing
