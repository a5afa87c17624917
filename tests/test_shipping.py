"""Python task code reaches executors by value: queries with mapInPandas /
applyInPandasWithState run from a working directory where the package is not importable."""

import os
import subprocess
import sys
import tempfile
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent(f"""
    import importlib.util
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    spec = importlib.util.spec_from_file_location("entry_mod", "{REPO}/__spark_entry__.py")
    E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
    for name in ("knn_normal_prob", "stream_verdict_cascade", "stream_keyed_count_blocks", "recon_error_pca"):
        print(name, E.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
""")


def test_python_tasks_run_without_the_package_on_executors():
    with tempfile.TemporaryDirectory() as cwd:
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        proc = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                              text=True, timeout=900)
    assert proc.returncode == 0, proc.stderr[-2000:]
    counts = dict(line.split() for line in proc.stdout.splitlines() if line.strip())
    assert set(counts) == {"knn_normal_prob", "stream_verdict_cascade", "stream_keyed_count_blocks",
                           "recon_error_pca"}
