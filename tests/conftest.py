import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from sparkprep.session import get_session

    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkprep-tests-"))
    yield session
    session.stop()


@pytest.fixture
def small(spark):
    """The six-row session table whose answers are worked out by hand."""
    rows = [
        (0, 1.0, 10.0, "A", 0),
        (1, 2.0, 20.0, "B", 1),
        (2, None, 30.0, "A", 0),
        (3, 4.0, None, "B", 1),
        (4, 5.0, 50.0, "C", 0),
        (5, 100.0, 60.0, "A", 1),
    ]
    return spark.createDataFrame(rows, "id long, feature1 double, feature2 double, feature3 string, target int").coalesce(2)
