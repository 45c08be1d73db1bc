import os

import pytest

from larkspur.session import build_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TZ", "UTC")
    return build_session("tests", "local[8]", 8, **{"spark.driver.memory": "6g", "spark.sql.autoBroadcastJoinThreshold": "256k"})


@pytest.fixture(scope="session")
def data():
    return DATA
