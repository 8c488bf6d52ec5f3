import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_is_named_once():
    names = list(entry.queries())
    assert len(names) == len(set(names)) and set(entry.oracle_sql()) <= set(names)
    assert {"p2_found", "p3_found", "p6_found"} <= set(names)


def test_core_doesnt_import_llm():
    for path in (ROOT / "foliomill").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(".llm" in n for n in names), path


def test_flagship(spark):
    df = entry.entry(spark)
    assert "accepted" in df.columns and df.count() > 0
