import os
import sys
import tempfile
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, app="ledgerline-tests")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ledgerline-test-"))
    yield session
    session.stop()


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)


def usage_rows(spark, rows):
    """USAGE DataFrame from dicts with defaults (ts as naive UTC datetime)."""
    from ledgerline.schema import USAGE

    defaults = dict(model="gpt-5", session_id="", project="", input=0, output=0, cache_read=0, cache_write=0,
                    reasoning=0, raw_cost=None)
    full = []
    for r in rows:
        d = {**defaults, **r}
        full.append(tuple(d[c] for c in [f.name for f in USAGE.fields]))
    return spark.createDataFrame(full, USAGE)


def prices_from(spark, mapping):
    import json

    from ledgerline.sources.prices import parse_price_documents

    return parse_price_documents(spark.createDataFrame([(json.dumps(mapping),)], "value string"))


T0 = datetime(2026, 7, 1, 10, 0, 0)
