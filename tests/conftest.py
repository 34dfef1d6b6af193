import pytest

from cuework.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests")
    # tiny inputs: compiling stages would take longer than running them
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    s.conf.set("spark.sql.shuffle.partitions", "2")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
