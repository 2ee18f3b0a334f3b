"""The driver loads __spark_entry__.py from elsewhere with its own plain
session: the Python workers must still find the package (shipped with
addPyFile), including for the Arrow UDFs."""
import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent(f"""
    import importlib.util
    spec = importlib.util.spec_from_file_location("entry", "{REPO}/__spark_entry__.py")
    E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    print("ENTRY", len(E.entry(spark).collect()))
    print("TEXT", E.queries()["clean_text"](spark, "/root/testdata/sf0.001").count())
    print("KEYS", set(E.oracle_sql()) <= set(E.queries()))
""")


def test_entry_from_foreign_cwd_with_plain_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    assert "ENTRY 485" in out.stdout and "TEXT 200" in out.stdout and "KEYS True" in out.stdout
