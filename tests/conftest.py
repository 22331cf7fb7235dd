import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import oracle  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return oracle.spark_session()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
