import os

import pytest

from quaymark.session import build_session

DATA = os.environ.get("QUAYMARK_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def tiny():
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    return d
