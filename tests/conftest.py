import pytest

from workload.check import session


@pytest.fixture(scope="session")
def spark():
    spark = session()
    yield spark
    spark.stop()
