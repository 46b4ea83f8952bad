import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from spanalign.session import local_session
    s = local_session("*", shuffle_partitions=8, app="spanalign-tests", driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """FIXTURES.md 'texts': empty, blank, null, CRLF, e-acute, CJK, emoji
    (4 bytes, 2 UTF-16 units), underscore and digits next to letters."""
    rows = [
        (1, "py", "foo_bar1 = baz(2)\n"),
        (2, "py", "é字😀ab cd"),
        (3, "js", ""),
        (4, "js", "   \t\n"),
        (5, "js", None),
        (6, "go", "line1\r\nline2\rline3"),
        (7, "go", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, grp string, text string")
