"""The driver imports __spark_entry__ from another working directory with its own session:
executor Python workers must still find the package."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
import __spark_entry__ as E
df = E.entry(spark)
print('ROWS', len(df.collect()), df.columns)
print('Q', E.queries()['probe_status'](spark, '/root/testdata/sf0.001').count())
"""


def test_entry_from_other_directory():
    cwd = tempfile.mkdtemp(prefix="driver-like-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.startswith(("ROWS", "Q"))]
    assert lines[0].startswith("ROWS") and "['base_type', 'total']" in lines[0]
    assert int(lines[1].split()[1]) > 0
