import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert all("LIMIT" not in text or name.startswith("order_") for name, text in sql.items())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["bucket", "value"]


def test_library_without_the_llm_folders(tmp_path):
    """Everything else imports when these folders are not there."""
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("emberlog.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__
assert not [q for q in __spark_entry__.queries() if q.startswith("op") and q[2].isdigit()]
assert "sel_eq" in __spark_entry__.queries()
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_llm():
    for file in (ROOT / "emberlog").rglob("*.py"):
        if "llm" in file.relative_to(ROOT / "emberlog").parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), file


def test_users_values_never_become_sql():
    for file in (ROOT / "emberlog" / "plans").glob("*.py"):
        assert "expr(" not in file.read_text() and ".sql(" not in file.read_text()
