import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))


@pytest.fixture
def docs(spark):
    """Documents from texts: ids 0, 1, ...; a dict's keys are ids. Clashing extra columns come along."""

    def make(texts, lang="en"):
        rows = list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts))
        schema = "doc_id long, text string, lang string, source string, n_chars long, id long, block int, score double, label string"
        return spark.createDataFrame([(i, t, lang, None, None, 7, 1, 0.5, "x") for i, t in rows], schema)

    return make
