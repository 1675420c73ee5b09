"""Every registered query with SQL against that SQL in DuckDB; the others run and keep their invariants."""

import pytest

from stocktide.plans.catalogue import ORACLES, QUERIES

from .compare import connect, differences


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    assert differences(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()) == ""


def test_entry_imports_without_the_training_data_part(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def no_llm(name, *a, **k):
        if name.startswith("corpus_pipeline") or "stocktide.llm" in name or (name == "stocktide" and "llm" in str(a)):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", no_llm)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" not in entry.queries() and "hierarchy_rollup" in entry.queries()
    sys.modules.pop("__spark_entry__", None)
