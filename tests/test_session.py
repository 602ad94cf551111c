"""Queries run from any folder; scratch tables lie where all executors see them."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from fleetpulse.session import scratch

REPO = Path(__file__).resolve().parent.parent
PROBE = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as e
from fleetpulse.session import local_session
print("rows", e.queries()["counter_rate"](local_session(2), "/root/testdata/sf0.001").count())
"""


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="driver tables not present")
def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert int(out.stdout.rsplit("rows", 1)[-1]) > 0, out.stderr[-2000:]


class Session:
    """What scratch() asks of a session."""

    def __init__(self, folder, master="local[2]"):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})
        given = type("Option", (), {"isDefined": lambda self: False})()
        self._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: given})()})()


def test_scratch_in_the_named_folder():
    assert scratch(Session("hdfs://x/shared/"), "a").startswith("hdfs://x/shared/a-")
    assert "/fleetpulse-" in scratch(Session(None), "a")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Session(None, "spark://host:7077"), "a")
