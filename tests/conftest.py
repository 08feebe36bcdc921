import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from recordlens.session import session

    with tempfile.TemporaryDirectory() as shared:
        s = session(
            "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.checkpoint.dir": shared, "spark.ui.showConsoleProgress": "false"}
        )
        s.sparkContext.setLogLevel("ERROR")
        yield s
        s.stop()
