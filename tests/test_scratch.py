"""Scratch tables, and the entry module without the training-data operators."""

import os
import subprocess
import sys

import pytest

from millrace.sources import scratch

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_tables_of_a_finished_job_are_gone(spark):
    with scratch.temporary() as own:
        kept, other = scratch.written(spark.range(5)), scratch.written(spark.range(7))
        own.remove(kept)
    assert kept.count() == 5 and not os.path.exists(other.scratch.removeprefix("file://"))
    scratch.dropped(kept)
    assert not os.path.exists(kept.scratch.removeprefix("file://"))


def test_tables_go_when_the_driver_ends(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from millrace.sources import scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
print(scratch.written(spark.range(5)).count(), sum(x[:9] == "millrace-" for x in __import__("os").listdir("{tmp_path}")))
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=REPO, timeout=120)
    assert out.stdout.split() == ["5", "1"], out.stderr
    assert not [x for x in os.listdir(tmp_path) if x.startswith("millrace-")]


class Cluster:
    """A session whose executors are on other machines and that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master = "local-cluster[3,2,1000]"


@pytest.mark.parametrize("master", ["spark://there:7077", "yarn", "k8s://there", "local-cluster[3,2,1000]"])
def test_a_cluster_needs_a_shared_folder(master):
    Cluster.sparkContext.master = master
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        scratch.shared_dir(Cluster())


@pytest.mark.parametrize("missing", ["ahocorasick", "xxhash", "corpus_pipeline", "millrace.llm"])
def test_other_queries_do_not_need_the_training_data_operators(missing):
    code = f"""
import sys
sys.modules["{missing}"] = None
import __spark_entry__ as e
print(len(e.queries()), sum(n[:3] != "op_" for n in e.queries()), len(e.oracle_sql()))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=REPO, timeout=120)
    all_, odd, sql = map(int, out.stdout.split())
    assert all_ > 100 and odd == 0 and sql > 90
