import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    from fleet_health.session import build_session

    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="4",
                            spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                            spark__driver__memory="4g",
                            spark__python__sql__dataFrameDebugging__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
