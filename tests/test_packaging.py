"""Python-worker operators must work whatever the driver's working directory
(workers import the package shipped with addPyFile, not the driver's sys.path)."""

import os
import subprocess
import sys
import tempfile

from conftest import ROOT, SF_SMALL

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("N", E.queries()["credit_admission"](spark, {SF_SMALL!r}).count(),
      E.queries()["search_topk_batch"](spark, {SF_SMALL!r}).count())
"""


def test_python_worker_queries_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="refinery-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    lines = [line for line in out.stdout.splitlines() if line.startswith("N ")]
    assert lines, out.stderr[-2000:]
    n_keys, n_hits = map(int, lines[0].split()[1:])
    assert n_keys > 0 and n_hits > 0
