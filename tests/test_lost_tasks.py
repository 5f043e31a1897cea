"""Results are whole when first attempts of tasks are lost."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from tagwright.functions.prompts import Prompt
from tagwright.operators.predict import predict, predict_once
from tagwright.operators.score import accuracy, score
from tagwright.spec import TaskSpec

# Every task may be tried four times.
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
rows = spark.range(200).select(
    F.col("id").alias("example_id"), F.lit("text").alias("symptoms"), F.lit("allergy").alias("diagnosis"))


def build():
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")
    return lambda system, messages: ["allergy"] * len(messages)


kept = predict_once(score(predict(rows, build, Prompt(TaskSpec("t", ("allergy",))), parallelism=4)))
assert kept.count() == kept.select("example_id").distinct().count() == 200
assert tuple(accuracy(kept).first()) == (1.0, 200)
print("whole")
"""


def test_lost_first_attempts():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", SCRIPT, root], capture_output=True, text=True, timeout=180)
    assert "whole" in done.stdout, done.stderr[-3000:]
