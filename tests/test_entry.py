"""The driver's contract, with and without the llm folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


def test_flagship(spark, sf):
    assert entry.entry(spark).count() > 0


def test_the_rest_imports_without_llm(tmp_path):
    for name in ("pelagos", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "pelagos/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'contacts_by_cell_status' in q and not any(k.startswith('op') and k[2:3].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
