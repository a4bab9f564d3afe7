from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from horizonkit.session import build_session  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="hk-test-ckpt-")
    s = build_session(
        "local[*]", "horizonkit-tests", shuffle_partitions=8,
        extra_conf={"spark.checkpoint.dir": ckpt},
    )
    yield s
    s.stop()
