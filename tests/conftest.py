import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logweft.staging import Staging  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("logweft-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def staging(spark):
    with Staging(spark) as opened:
        yield opened


@pytest.fixture
def logs(tmp_path):
    """Write log files into a fresh directory: ``logs({"a.log": "..."})``."""

    def write(files) -> str:
        folder = tmp_path / "logs"
        folder.mkdir(exist_ok=True)
        for name, content in files.items():
            data = content if isinstance(content, bytes) else content.encode()
            (folder / name).write_bytes(data)
        return str(folder)

    return write
