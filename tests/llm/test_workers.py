"""Executors that have Spark's Python environment but not this package."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's path alone: workers start in another folder
from donorlake.session import build_session
from donorlake.llm.queries import QUERIES
from donorlake.llm.text import Shared

spark = build_session("workers", "local[2]", spark__sql__shuffle__partitions="2", spark__driver__memory="2g", spark__checkpoint__dir={folder!r})
spark.sparkContext.setLogLevel("ERROR")

def found(_):
    try:
        import donorlake
        yield True
    except ImportError:
        yield False

assert spark.sparkContext.parallelize([0], 1).mapPartitions(found).collect() == [False]
for name in ("op1_bpe", "op5_quality", "op9_secrets", "op10_decontaminate", "op12_spelling", "op13_lines"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_operators_run_where_workers_lack_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=root, folder=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
