import os
import subprocess
import sys

import pytest

from murmurlake import session as S

ALONE = """
from murmurlake.session import drop_scratch, local_session, materialise, scratch, shared_dir, _SCRATCH
import os
spark = local_session(cores="1", memory="1g", shuffle=1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = materialise(spark.range(3))
path = _SCRATCH[-1]
with scratch(spark):
    inner = materialise(spark.range(2))
    assert inner.count() == 2 and len(_SCRATCH) == 2
assert len(_SCRATCH) == 1 and df.count() == 3 and os.path.exists(path)
drop_scratch(spark)
assert not os.path.exists(path)
print("fine")
"""


def test_a_session_without_the_setting(tmp_path):
    """With an empty conf folder nothing names a shared folder; a local session gets its own."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(sys.path)}
    done = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=180)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_a_cluster_needs_the_setting():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(Session())
