"""Every query with SQL agrees with DuckDB on the smallest tables."""

import inspect
import os

import pytest

from quarry.plans import registry
from tests import oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert oracle.difference(df, con, registry.ORACLE_SQL[name]) is None
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(inspect.signature(__spark_entry__.queries()["exact_name"]).parameters) == 2


def test_library_does_not_need_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name in ('corpus_pipeline', 'quarry.llm'): raise ModuleNotFoundError(name, name=name)\nsys.modules.pop('corpus_pipeline'); sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'exact_name' in e.queries() and 'pipeline' not in e.queries() and 'op1_poisson_replication' not in e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
