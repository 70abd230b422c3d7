"""The text queries that SQL can express are compared by tests/test_oracles.py; here, that none is missing."""

import re

from millrace.llm.queries import ORACLES, QUERIES


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert all(re.fullmatch(r"op\d+_\w+|pipeline", name) for name in QUERIES)
