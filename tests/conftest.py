import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from galewatch.session import build_session

    session = build_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri(),
            "spark.sql.warehouse.dir": tmp_path_factory.mktemp("warehouse").as_uri(),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
