"""Tasks of the text operators run where the package cannot be imported."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from cellframe.plans.session import local_session
import __spark_entry__ as e
spark = local_session(4)
for name, query in e.queries().items():
    if name.startswith("op"):
        print("rows", name, query(spark, "/root/testdata/sf0.001").count())
"""


def test_workers_do_not_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.count("rows op") == 13, out.stderr[-3000:]
