import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def odd(spark):
    from helpers import awkward

    return awkward(spark).cache()
