import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lintlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, memory="4g")


@pytest.fixture
def rows():
    def as_dicts(df, *columns):
        picked = df.select(*columns) if columns else df
        return [r.asDict(recursive=True) for r in picked.collect()]

    return as_dicts
