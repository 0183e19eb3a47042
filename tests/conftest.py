import os

import pytest

from weftline.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    s = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF
