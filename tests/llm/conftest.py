import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (doc_id, text) with two columns whose names the operators use themselves."""

    def make(rows, extra=True):
        data = [(i, t, "en", f"k{k}", k) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string, _k1 string, key1 int")
        return df if extra else df.select("doc_id", "text")

    return make
