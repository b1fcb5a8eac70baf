"""The driver contract without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_other_queries_remain_without_the_training_data_folders(scratch):
    copy = f"{scratch}/repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    os.makedirs(f"{copy}/connrisk/llm/__pycache__")  # an empty folder left behind
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), len(s), any(n.startswith(('op', 'pipeline')) and n[2:3].isdigit() for n in q))"
    for drop in ((), ("corpus_pipeline.py",)):
        for name in drop:
            os.remove(f"{copy}/{name}")
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert out.returncode == 0, out.stderr
        n_queries, n_sql, any_llm = out.stdout.split()
        assert int(n_queries) >= 53 and int(n_sql) >= 53 and any_llm == "False"
