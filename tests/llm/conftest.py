import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (doc_id, text[, lang[, source]]), with more columns that could clash."""

    def build(rows, clash=()):
        full = [(*row, *[None] * (4 - len(row)))[:4] for row in rows]
        full = [(*row, len(row[1]) if row[1] is not None else None) for row in full]
        df = spark.createDataFrame(full, DOCUMENTS)
        for name in clash:
            df = df.withColumn(name, df["doc_id"])
        return df

    return build
