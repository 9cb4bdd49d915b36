"""The entry without optional packages, and workers that have no copy of this package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]


def run(code, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout.split()


def test_a_missing_package_costs_only_the_optional_queries(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(REPO)!r}); {{}}; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    every, without = run(code.format("pass"), tmp_path), run(code.format("sys.modules['xxhash'] = None"), tmp_path)
    assert every[1] == "True" and without[1] == "False" and int(without[0]) == int(every[0]) - 14 >= 107


def test_workers_get_the_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from tillspark.llm import queries, runs, token_counts
docs = spark.createDataFrame([(1, "a b " * 9)], "doc_id long, text string")
print(token_counts.count_tokens(docs, queries.BYTE_BPE).first().n_tokens, runs.periodic_runs(docs).first().found.n_words)
"""
    assert [int(x) > 0 for x in run(code, tmp_path)] == [True, True]
