import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import local_session

    return local_session(4, shuffle_partitions=6, memory="4g")


@pytest.fixture(scope="session")
def tables(spark):
    from riskloom.plans.tables import Tables

    return Tables(spark, SMALL)
