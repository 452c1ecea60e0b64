import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest_odd import ODD_TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def tokens_path():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def pieces_path():
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a row without an id, and a repeated row; columns that operators use inside stand in the way."""
    rows = [(n, t, None, "s", 0, 1, "k") for n, t in enumerate(ODD_TEXTS)]
    rows += [(None, "Hello, world.", None, None, None, None, None), rows[5]]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint int, key string"
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
