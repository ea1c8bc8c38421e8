"""The registration: names, oracles for known queries only, every module importable without llm."""

import importlib
import sys

import __spark_entry__ as entry


def test_oracles_belong_to_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100 and "p6_found" in q


def test_nothing_else_imports_llm():
    before = {m for m in sys.modules if m.startswith("lectern.llm")}
    for m in entry.MODULES:
        if ".llm" not in m:
            importlib.import_module(m)
    assert {m for m in sys.modules if m.startswith("lectern.llm")} == before


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity", "account_id", "book_id", "h", "change_id"] and df.count() > 0
