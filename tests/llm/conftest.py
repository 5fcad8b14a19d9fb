import pytest


@pytest.fixture
def documents(spark, tmp_path):
    """Writes rows as the documents table of a folder of its own; returns the folder."""

    def write(rows, extra="", parts=2):
        columns = "doc_id long, text string" + (f", {extra}" if extra else "")
        spark.createDataFrame(rows, columns).repartition(parts).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write
