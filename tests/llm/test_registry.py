import os
import subprocess
import sys
from pathlib import Path

import pytest

from graphloom.llm.registry import ORACLE, QUERIES


def test_one_query_an_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE[name])


def test_workers_need_not_have_the_package(tmp_path, sf_dir):
    """Only the driver can import it; what runs in Python workers is sent there whole."""
    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from graphloom.llm.registry import QUERIES
for name in {sorted(QUERIES)!r}:
    QUERIES[name](spark, {sf_dir!r}).write.format("noop").mode("overwrite").save()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=600)
