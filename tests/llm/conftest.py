import pytest

from airtally.llm.queries import find_package


@pytest.fixture(autouse=True)
def package(spark):
    find_package(spark)
