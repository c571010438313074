"""The entry module without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from gridloom.session import remove_folder, shared_folder

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from gridloom.plans import ORACLES, QUERIES
assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
if len(sys.argv) > 1:
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    assert entry.entry(spark).count() > 0
"""


@pytest.mark.parametrize("gone", [["gridloom/llm", "tests/llm"], ["gridloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        at = copy / name
        (shutil.rmtree if at.is_dir() else os.remove)(at) if at.exists() else None
    done = subprocess.run([sys.executable, "-c", RUN, *gone[2:]], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


class FakeSession:
    """A session of a cluster whose shared folder is or is not named."""

    def __init__(self, conf):
        self.sparkContext, self.conf, self.master = self, conf, "spark://host:7077"

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return None


def test_no_machine_local_folder_on_a_cluster(spark, tmp_path):
    assert shared_folder(FakeSession({"spark.checkpoint.dir": "hdfs://x/shared/"})) == "hdfs://x/shared"
    with pytest.raises(RuntimeError):
        shared_folder(FakeSession({}))
    assert shared_folder(spark)
    spark.range(3).write.parquet(str(tmp_path / "t"))
    remove_folder(spark, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()
