"""The entry module stands without the training-data operators, and nothing else imports them."""

import os
import pathlib
import re
import shutil
import subprocess
import sys

from driftglass.plans import catalog

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry_without_training_operators():
    code = "import sys; sys.modules['driftglass.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'sma_20' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for path in (ROOT / "driftglass").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"driftglass\.llm|corpus_pipeline", path.read_text()), path


def test_entry_without_the_folders(tmp_path):
    """A copy without the training-data folders and the pipeline still imports, with all other queries."""
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, timeout=120, check=True)
    n, m, any_op = done.stdout.split()[-3:]
    assert int(n) == len(catalog.QUERIES) and int(m) == len(catalog.ORACLES) and any_op == "False"
