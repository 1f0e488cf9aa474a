import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent
SMALLEST = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["segment", "n", "total"]


def test_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q, len(e.oracle_sql()) > 50)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, ops, pipeline, sql = out.stdout.split()
    assert int(n) > 90 and (ops, pipeline, sql) == ("0", "False", "True")
