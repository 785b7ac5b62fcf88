import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g", partitions=4)
    yield session
    session.stop()


def turns_of(spark, conversations):
    """conversations: list of lists of texts; roles alternate, the last turn is a user turn."""
    rows = []
    for cid, texts in enumerate(conversations):
        for i, text in enumerate(texts):
            role = "user" if (len(texts) - 1 - i) % 2 == 0 else "assistant"
            rows.append((cid, i, role, text))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
