"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["bin", "mean", "n"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    for p in REPO.iterdir():
        if p.name not in ("weirflow", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "weirflow").mkdir()
    for p in (REPO / "weirflow").iterdir():
        if p.name != "llm":
            (tmp_path / "weirflow" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'describe' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"})
