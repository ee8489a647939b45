from __future__ import annotations

import os

import pytest

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from quantspark.session import build_session

    session = build_session(
        "tests",
        "local[4]",
        4,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
