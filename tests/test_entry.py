"""The driver contract where what the text operators need is missing."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.modules["sentencepiece"] = None
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert "neutron_spectrum" in names and "hits_ns" in sql, names
assert not any(n.startswith("op") or n == "pipeline" for n in names)
"""


def test_missing_dependency():
    subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).resolve().parents[1], check=True)
