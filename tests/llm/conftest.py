import pytest

from pulselake.llm import common


@pytest.fixture
def docs(spark):
    """Documents with the odd cases: nulls, empty and long texts, repeats, clashing extra columns."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", 0.5) for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double")

    return make


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def read(spark, sf):
    return lambda name: common.table(spark, sf, name)
