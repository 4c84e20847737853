"""The driver contract in __spark_entry__.py."""
import importlib.util
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_returns_flag_summary(spark):
    m = _entry_module()
    df = m.entry(spark)
    assert df.columns == ["order_no", "delay_reason", "total_cases", "major_delay", "pct_major", "pct_minor"]
    rows = df.collect()
    assert len(rows) == 10 and sum(r["total_cases"] for r in rows if r["order_no"] == 0) > 0


def test_oracle_keys_are_queries():
    m = _entry_module()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90 and all(isinstance(v, str) and v.strip() for v in o.values())


@pytest.mark.parametrize("library", ["zstandard", "regex"])
def test_a_missing_library_costs_only_its_queries(library, monkeypatch):
    """Without a library that only the training-data queries need, the others are registered, with a warning."""
    for name in [m for m in sys.modules if m.startswith("apptflow.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, library, None)
    if os.path.isdir(os.path.join(ROOT, "apptflow", "llm")):
        with pytest.warns(UserWarning, match=library):
            m = _entry_module()
    else:
        m = _entry_module()
    assert "flag_summary" in m.queries() and not any(k.startswith("op") and "_" in k[:5] for k in m.queries())


def test_an_error_inside_the_library_is_raised(monkeypatch):
    m = _entry_module()

    def broken(name):
        raise ModuleNotFoundError("No module named 'apptflow.functions.none'", name="apptflow.functions.none")

    monkeypatch.setattr(m.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        m._optional("corpus_pipeline")
