import pytest

from chartline import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
