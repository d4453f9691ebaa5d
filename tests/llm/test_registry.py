import os

import pytest

from timelode.llm import registry
from timelode.llm.personal_information import Training

DATA = os.environ.get("TIMELODE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs(spark, name):
    short = {"training": Training(shards=2, rounds=2, windows=200)} if name.startswith("p8") else {}
    df = registry.QUERIES[name](spark, DATA, **short)
    assert df.columns and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(registry.SQL) <= set(registry.QUERIES)
