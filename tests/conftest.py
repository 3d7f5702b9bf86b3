from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from innsight.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8, app_name="innsight-tests")
    # tests run on one machine: give the session a staging folder when the
    # launcher did not (a cluster names a shared one in spark.checkpoint.dir)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="innsight-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture(scope="session")
def rows():
    from fixture import make_rows

    return make_rows(seed=7)


@pytest.fixture(scope="session")
def t(spark, rows):
    from fixture import spark_tables

    return spark_tables(spark, rows)


@pytest.fixture(scope="session")
def duck(rows):
    from fixture import duck_tables

    return duck_tables(rows)
