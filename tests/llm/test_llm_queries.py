import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connect, same

from skein.llm import queries
from skein.llm.sql import SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, sf, con, name):
    same(queries.QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    queries.QUERIES[name](spark, sf).count()
