import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from palimpsest.session import local_session

    session = local_session(4, 4, {"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()
