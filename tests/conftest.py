import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from measurelake.session import local_session

    cores = os.environ.get("TEST_CPUS", "4")
    return local_session(cores, spark__driver__memory="3g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
