import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tabeval.session import build_session
    s = build_session("tabeval-tests", cores=4, shuffle_partitions=4)
    yield s
    s.stop()


def rows(df):
    return [tuple(r) for r in df.collect()]
