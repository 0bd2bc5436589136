import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tests_llm_data import ODD, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns that bear the names of results and helpers."""
    from pyspark.sql import functions as F

    names = ["score", "predicted", "kept", "n_words", "ids", "key", "token", "part", "rank", "node", "label", "__m", "lang_pred", "tokens", "start"]
    return odd.select("*", *(F.lit("clash").alias(n) for n in names))
