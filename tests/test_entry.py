import importlib
import sys

import __spark_entry__


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 6


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_subpackage(monkeypatch):
    """The rest imports, and its queries are there, where that subpackage was removed."""
    for name in [m for m in sys.modules if m.startswith("gridloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "gridloom.llm", None)
    names = set(importlib.reload(__spark_entry__).queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
    assert "run_metrics" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
