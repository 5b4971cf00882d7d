import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from tokenloom.operators import tokenizers as T
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([("Hello world!",)], "text string")
print("counted", T.count_exact(df, T.RankVocabulary(T.synthetic_ranks())).first()["count"])
"""


def test_workers_get_the_package_where_it_is_not_installed(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "counted 10" in done.stdout, done.stderr[-2000:]


def test_small_inputs_in_few_files_are_dealt_out(spark, tmp_path):
    from tokenloom.operators.spread import spread

    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(2 * cores).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert spread(one).rdd.getNumPartitions() == cores and spread(one).count() == 100
    assert "RepartitionByExpression" not in spread(many)._jdf.queryExecution().toString() and "Repartition " not in spread(many)._jdf.queryExecution().toString()
