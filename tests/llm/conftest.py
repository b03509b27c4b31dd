from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table; extra columns have the names that operators use inside."""

    def make(rows, kind=DOCS, extra=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) if kind == DOCS else r for r in rows], kind)
        for name in ("id", "digest", "blob", "key", "cls", "n", "name", "hits", "score", "component", "rules", "start", "end") if extra else ():
            if name not in df.columns:
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
