import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from streamlearn import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4, spark__ui__enabled="false", spark__driver__memory="8g",
                  spark__checkpoint__dir=tempfile.mkdtemp(prefix="streamlearn-test-"),
                  spark__cleaner__referenceTracking__cleanCheckpoints="true")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
