import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from offerlake.session import checkpoint_root, get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="offerlake-tests", shuffle_partitions=8,
                    extra={"spark.driver.memory": "4g"})
    checkpoint_root(s)  # tests: a private folder only if the session names none
    yield s


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect())
