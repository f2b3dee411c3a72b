import pytest


@pytest.fixture
def documents(spark):
    """A table of documents with some rows, and columns that operators use as names of their own."""
    def make(*rows, **extra):
        rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2.0)
                if not isinstance(t, tuple) else (*t, None, 1, "x", 2.0)
                for i, t in enumerate(rows)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, "
                  "size long, term string, component_id double")
    return make
