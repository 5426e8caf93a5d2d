import pytest


@pytest.fixture
def documents(spark):
    """A table of documents from texts, or from (id, text) pairs."""
    def make(rows, more=()):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(*r, "en", f"s{(r[0] or 0) % 3}", len(r[1] or ""), *more) for r in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long"
                                     + "".join(f", x{i} string" for i in range(len(more))))
    return make
