import pytest
from pyspark.sql import functions as F

from tessera.llm.common import with_checkpoints

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use themselves."""

    def build(rows, *, lang="en", extra=True):
        df = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], COLUMNS)
        if extra:
            df = df.withColumns({"fp": F.lit("x"), "score": F.lit(1), "spans": F.lit(None).cast("string"), "node": F.lit(2), "at": F.lit(3)})
        return with_checkpoints(spark, df)

    return build


@pytest.fixture(scope="session")
def docs(spark, sf):
    return with_checkpoints(spark, spark.read.parquet(f"{sf}/documents.parquet"))


ODD = [(None, None), (None, "a b c"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "same words here " * 30), (5, "same words here " * 30), (6, "same words here " * 30), (7, "é漢😀 " * 40), (8, "w" * 5000)]
