"""Scope to shards, and log to audited log, each as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pinlattice.operators.matrix import assign_shards, experiment_matrix, matrix_order
from pinlattice.operators.observations import pending, repair_results, structural_audit


def runnable_shards(scope: DataFrame, families: DataFrame, size: int) -> DataFrame:
    """Coverage-filtered product, ordered and cut into shards."""
    matrix = experiment_matrix(scope, families, runnable_only=True)
    return assign_shards(matrix_order(matrix), size)


def retry_list(matrix: DataFrame, results: DataFrame) -> DataFrame:
    """Experiments to run again after the log was repaired."""
    return pending(matrix, repair_results(results))


def audited(matrix: DataFrame, results: DataFrame) -> DataFrame:
    return structural_audit(matrix, repair_results(results))
