"""Session helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own_folder: str | None = None


def _base_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where the setting is unset, as in tests, one folder serves the whole process and
    is removed at its end. A cluster has to name a folder every executor can reach.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if _own_folder is None:
            _own_folder = tempfile.mkdtemp(prefix="pinlattice-")
            atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
        folder = _own_folder
    return folder.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path every executor can reach, for tables written between steps of a plan."""
    return f"{_base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_base_folder(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over ``spark.sql.shuffle.partitions`` tasks and written once.

    For tables that are read many times, such as training rows: one large file would
    otherwise keep every pass in one task.
    """
    return materialize(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


# Training rows that a task of a pass reads, about.
_PASS_ROWS = 1 << 22


def tasks_of_passes(df: DataFrame, rows: int) -> int:
    """Tasks of jobs that pass over ``rows`` rows of ``df`` many times: a round of all cores, or several where a task would get too many rows.

    Starting a task costs more than a few hundred thousand rows of a pass.
    """
    cores = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    return cores * max(1, -(-rows // (cores * _PASS_ROWS)))
