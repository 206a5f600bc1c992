import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from usagemill.session import get_spark

    session = get_spark("tests", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session
