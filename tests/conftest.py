"""One local session for all tests."""

from __future__ import annotations

from collections.abc import Iterator

import pytest
from pyspark.sql import SparkSession

from plumbline.session import local_session


@pytest.fixture(scope="session")
def spark() -> Iterator[SparkSession]:
    session = local_session("8", shuffle_partitions=4, app="plumbline-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
