import importlib
import sys

import __spark_entry__ as entry


def test_flagship_and_names(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_works_without_the_optional_part(monkeypatch):
    """The entry imports and registers the core's queries when the optional part can't be imported."""
    for name in [n for n in sys.modules if n.startswith("ledgerloom.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ledgerloom.llm", None)
    try:
        alone = importlib.reload(entry)
        assert alone.llm is None and {"p2_found", "p5_found", "q_grouped_metrics"} <= set(alone.queries()) and "p1_found" not in alone.queries()
        assert set(alone.oracle_sql()) <= set(alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
