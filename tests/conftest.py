import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from layerloom.session import session

    found = session("local[4]", "tests", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    found.sparkContext.setLogLevel("OFF")
    yield found
    found.stop()


@pytest.fixture
def scenario():
    """A bundled scenario as plain JSON values, to be changed by tests."""
    import json

    from layerloom.cli import bundled

    return lambda name="library_loans_001": json.loads(bundled()[name].read_text())
