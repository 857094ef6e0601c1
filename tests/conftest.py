import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from attrix.session import local_session, release_shared_tables
    session = local_session(cores=4, shuffle_partitions=8)
    yield session
    release_shared_tables(session)
    session.stop()


@pytest.fixture(scope="session")
def duck_small():
    from oracle_helpers import duck
    return duck(SF_SMALL)


@pytest.fixture(scope="session")
def duck_check():
    from oracle_helpers import duck
    return duck(SF_CHECK)
