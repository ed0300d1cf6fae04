import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import ensure_checkpoint_dir, local_session

    s = local_session("*", 8, "ledgerline-tests")
    ensure_checkpoint_dir(s)  # tests run locally: a scratch checkpoint folder
    yield s
    s.stop()
