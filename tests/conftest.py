import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from larkspur.session import session

    spark = session("larkspur-tests", cores=4, shuffle_partitions=4)
    yield spark
    spark.stop()
