"""The entry gives the campaign queries wherever the training-data subpackage cannot be imported."""

import os
import subprocess
import sys

from liftworks.plans.registry import ORACLE_SQL, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_a_library_of_the_subpackage():
    code = "import sys; sys.modules['zstandard'] = sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))]
