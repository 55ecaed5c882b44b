import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pagegrain.session import build_session

    s = build_session("local[4]", "tests", spark_sql_shuffle_partitions="4", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
