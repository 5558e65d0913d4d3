"""The driver's contract."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_a_schema_and_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_the_subpackage_imports_it():
    for p in (ROOT / "ledgerloom").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), p
