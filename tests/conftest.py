import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from valuelens.session import build_session, cleanup_materialized
    s = build_session(master="local[4]", app="valuelens-tests", shuffle_partitions=4,
                      extra={"spark.driver.memory": "4g"})
    yield s
    cleanup_materialized(s)
    s.stop()
