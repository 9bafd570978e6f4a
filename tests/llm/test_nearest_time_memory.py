import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# One partition whose buckets are several times the memory of its task: about 15 MB, in a JVM of its own.
SCRIPT = """
from pyspark.sql import SparkSession

memory = {"spark.driver.memory": "600m", "spark.memory.fraction": "0.05", "spark.buffer.pageSize": "1m", "spark.sql.shuffle.partitions": "1"}
quiet = {"spark.master": "local[1]", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
spark = SparkSession.builder.config(map=memory | quiet).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from tideglass.llm.nearest_time import nearest_in_time

left = spark.range(80_000).selectExpr("'a' AS e", "id * 50 + 7 AS t", "id AS l")
right = spark.range(200_001).selectExpr("'a' AS e", "id * 20 AS t", "id AS r")
got = nearest_in_time(left, right, "e", "t", "l", "r", 40, 5)
print("SAID", *got.selectExpr("count(*)", "count(DISTINCT l)", "count_if(r = round((l * 50 + 7) / 20))").first())
"""


def test_a_partition_larger_than_its_memory(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": ROOT}, timeout=300)
    assert "SAID 80000 80000 80000" in done.stdout, done.stderr[-2000:]
