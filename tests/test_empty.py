"""Every core query on tables without rows."""

import os

import pytest

from tests.test_queries import DATA, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{name}").limit(0).write.parquet(str(folder / name))
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
