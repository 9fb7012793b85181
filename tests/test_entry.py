import sys

import __spark_entry__
import pytest
from neargrid.plans.oracles import ORACLE_SQL
from neargrid.plans.queries import QUERIES


@pytest.mark.parametrize("missing", ["neargrid.llm.queries", "corpus_pipeline"])
def test_scoring_queries_outlive_a_failed_import(monkeypatch, missing):
    monkeypatch.setitem(sys.modules, missing, None)  # what `import` then raises is an ImportError
    with pytest.warns(UserWarning, match="left out"):
        names = set(__spark_entry__.queries())
        assert set(QUERIES) <= names and "pipeline" not in names
        assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_a_missing_library_of_the_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("neargrid.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.warns(UserWarning, match="left out"):
        assert set(__spark_entry__.queries()) >= set(QUERIES)
