import pytest


@pytest.fixture
def table(spark):
    """A documents table; rows are (doc_id, text) or (doc_id, text, source)."""

    def make(rows, extra=False, parts=3):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        if extra:
            from pyspark.sql import functions as F

            for name in ("kept", "n_words", "fp", "shard", "_row", "size"):
                df = df.withColumn(name, F.lit("mine"))
        return df

    return make
