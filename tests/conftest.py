import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslens.registry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, name="corpuslens-tests")
    session.conf.set("spark.sql.shuffle.partitions", 4)
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate one expression on literal values."""
    def evaluate(expression):
        return spark.range(1).select(expression.alias("x")).first()["x"]
    return evaluate
