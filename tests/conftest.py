import pytest

from tests.compare import connect, session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def duck():
    return connect(FOLDER)


@pytest.fixture
def tiny_chunks(spark):
    """Make every input count as large, so the skew-safe paths run."""
    spark.conf.set("faultspark.chunkBytes", "3000")
    spark.conf.set("faultspark.seriesChunk", "16")
    yield
    spark.conf.unset("faultspark.chunkBytes")
    spark.conf.unset("faultspark.seriesChunk")
