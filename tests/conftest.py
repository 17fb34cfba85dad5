import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from querymill.runtime import session
    from querymill.streaming.state import STATE_CONF

    conf = {k.replace(".", "_"): v for k, v in {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}.items()}
    made = session("tests", "local[4]", **conf)
    for k, v in STATE_CONF.items():
        made.conf.set(k, v)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture
def rows():
    """The rows of a frame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
