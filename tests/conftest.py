import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

TESTS = Path(__file__).resolve().parent
sys.path.insert(0, str(TESTS.parent))
# Python workers import the package and the completers defined in the tests.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(TESTS.parent), str(TESTS), os.environ.get("PYTHONPATH", "")]
)

from textquarry.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()
