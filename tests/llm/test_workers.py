import os
import subprocess
import sys


def test_workers_find_the_package(tmp_path):
    """The driver may import the package by a path that its workers do not have."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "run.py"
    script.write_text(
        f"""import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from growthlens.llm.cooccurrence import together
from growthlens.llm.encode import encode_texts
from growthlens.llm.splitting import split_oversized
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.createDataFrame([(u, i, "word " * 200) for u in range(6) for i in (1, 2)], "u int, i int, t string")
print("rows", together(df, "u", "i").count(), encode_texts(df, ["u"], "t").count(), split_oversized(df, "u", "t", 150, 10).count())
"""
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1 12 24" in done.stdout, done.stderr[-2000:]
