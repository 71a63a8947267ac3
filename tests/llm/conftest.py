import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm_data import EXTRA, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty and long texts, repeated rows and extra
    columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame(edge_rows(), schema)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
