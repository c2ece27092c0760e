import pytest

import __spark_entry__ as entry
from landreach.plans import geo_queries
from oracle import compare, database

LLM = entry.llm_queries.queries() if entry.llm_queries else {}


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.fixture(scope="module")
def chain(spark, data):
    """One chain for all queries, so that each of its steps is run once."""
    return geo_queries.Chain(spark, data)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in LLM])
def test_query(spark, data, con, chain, monkeypatch, name):
    monkeypatch.setattr(geo_queries, "Chain", lambda *_: chain)
    df = entry.queries()[name](spark, data)
    if name in entry.oracle_sql():
        assert compare(df, con, entry.oracle_sql()[name]) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['landreach.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith(('p1_', 'p7_')) for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0]).returncode == 0
