import pytest

from demandloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def rows(df, *order):
    """Sorted tuples of a frame."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
