import os
import sys

import pytest

for _p in (os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))):
    sys.path.insert(0, _p)


@pytest.fixture(scope="session")
def spark():
    from askance.session import local_session

    return local_session("tests", cores=4, partitions=4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
