import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sediment.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 2)
    # many small plans: compiling each costs more than it saves
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def path(tmp_path):
    return str(tmp_path)


def rows(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
