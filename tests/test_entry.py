"""The queries of this library without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    code = ("import __spark_entry__ as e; from casework.plans.library import QUERIES; "
            "assert set(e.queries()) == set(QUERIES) and 'evaluate_requests' in e.oracle_sql()")
    for emptied in (False, True):
        if emptied:
            (copy / "casework" / "llm").mkdir()
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
