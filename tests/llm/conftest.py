import pytest


@pytest.fixture(autouse=True)
def _quiet(interpreted):
    """Small inputs: no code generation."""


@pytest.fixture()
def docs(spark):
    """Documents with the columns of the given table."""

    def make(*rows):
        return spark.createDataFrame(
            [(r + (None,) * 5)[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long"
        )

    return make
