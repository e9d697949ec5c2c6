"""The driver's contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_names_and_sql():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) >= 100 and set(o) <= set(q)


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "total", "kept", "survival_rate"]


def test_without_the_optional_part(tmp_path):
    """Without the folder llm, with the pipeline's module or without it, the other queries are there."""
    top = Path(entry.__file__).resolve().parent
    shutil.copytree(top / "corpusmill", tmp_path / "corpusmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (top / name).exists():
            shutil.copy(top / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
