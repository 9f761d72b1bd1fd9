import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 60


def test_nothing_else_imports_the_optional_subpackage():
    for f in (ROOT / "lorekeep").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text()


def test_queries_run_from_another_folder(tmp_path):
    """Python workers get the package even where their path does not have it."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from lorekeep.session import local_session
spark = local_session(2, "elsewhere", 2)
print("ROWS", e.queries()["review_cadence"](spark, "/root/testdata/sf0.001").count())
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS 1000" in done.stdout, done.stderr[-2000:]
