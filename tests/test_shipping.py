"""Grouped pandas maps must work when the driver runs outside the repository folder:
executors import the package from the archive shipped with ``addPyFile``."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_grouped_maps_from_foreign_cwd(tmp_path):
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        import numpy as np, pandas as pd
        from pyspark.sql import SparkSession
        from ledgerline.operators.forecast.trend import trend_forecast
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        days = pd.date_range("2021-01-01", periods=120, freq="D")
        df = spark.createDataFrame(pd.DataFrame({{"ds": days.date, "y": np.arange(120.0)}}))
        print("FUTURE", trend_forecast(df, (), 5).points.where("is_future").count())
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "FUTURE 5" in out.stdout, out.stderr[-3000:]
