import os
import tempfile

import pytest

from weftlink.session import local

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    here = os.getcwd()
    with tempfile.TemporaryDirectory() as folder:
        session = local(4, "4g", {"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse"})
        yield session
        session.stop()
    os.chdir(here)


@pytest.fixture(scope="session")
def sf():
    return SF
