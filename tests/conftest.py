import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from govlens.session import local_session

    session = local_session(8, "6g")
    yield session
    session.stop()


@pytest.fixture
def lines(spark, tmp_path):
    """Write records as one JSON-lines file, give its path."""
    import json

    def write(records, name="feed.jsonl"):
        path = tmp_path / name
        path.write_text("".join(json.dumps(r) + "\n" for r in records))
        return str(path)

    return write
