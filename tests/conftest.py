import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tablewright.session import get_spark
    s = get_spark("local[*]", shuffle_partitions=8, spark__ui__enabled="false",
                  spark__ui__showConsoleProgress="false",
                  spark__checkpoint__dir=tempfile.mkdtemp(prefix="tw-test-ckpt-"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="tw-test-")
