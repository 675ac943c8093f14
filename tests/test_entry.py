"""The driver contract."""

import ast
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_names_agree():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {*o} <= {*q} and len(q) > 50


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), path
