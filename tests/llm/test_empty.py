"""Every query of the subpackage on tables without rows, and on dimensions without rows."""

import os

import pytest

from timelode.llm import registry

DATA = os.environ.get("TIMELODE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{name}").limit(0).write.parquet(str(folder / name))
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0
