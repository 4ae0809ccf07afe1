import importlib
import sys

import __spark_entry__ as entry
from weft.queries import ORACLE, QUERIES


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows[0].dist is not None and sum(r.n_vertices for r in rows) > 50


def test_entry_without_the_training_data_operators(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("weft.llm", "corpus_pipeline") else find(name, *a))
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE)
    assert "weft" in sys.modules
