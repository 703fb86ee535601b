"""The subpackage llm can be taken away."""

from __future__ import annotations

import ast
from pathlib import Path

import ledgerlens

ROOT = Path(ledgerlens.__file__).parent


def imported(path: Path) -> set[str]:
    names: set[str] = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            names |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            names |= {node.module, *(f"{node.module}.{a.name}" for a in node.names)}
    return names


def test_nothing_else_imports_it():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any(n.startswith("ledgerlens.llm") for n in imported(path)), path


def test_no_local_checkpoints_or_driver_paths():
    for path in ROOT.rglob("*.py"):
        assert "localCheckpoint(" not in path.read_text()
