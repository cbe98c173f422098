"""The shared folder without a preset, and written tables."""

import os
import subprocess
import sys
import tempfile

SCRIPT = """
import os
from tallyward import session
spark = session.build_session("bare", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = session.cut(spark.range(5))
path = session.shared_root(spark)
assert df.count() == 5 and os.path.isdir(path) and session.shared_root(spark) == path
assert session.release(spark) == 1 and os.listdir(path + "/tallyward") == []
assert session.release(spark) == 0
"""


def test_without_a_preset_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": tempfile.mkdtemp(prefix="no-conf-"), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
