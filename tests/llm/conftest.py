import pytest

from pinlattice.llm.registry import QUERIES  # noqa: F401


@pytest.fixture
def documents(spark):
    def make(rows, columns="doc_id long, text string"):
        return spark.createDataFrame(rows, columns)

    return make


@pytest.fixture
def tables(spark, tmp_path):
    """Writes named frames as tables and gives their folder."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
