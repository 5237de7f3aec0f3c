import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import default_session

    s = default_session(
        "tests",
        **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.default.parallelism": "2"},
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def db(spark, tmp_path):
    from lodestone.session import Database

    return Database(spark, str(tmp_path / "db"))
