"""Every operator id of the inventory keeps at least one registered query with oracle SQL."""

import os
import re
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


def test_every_operator_id_is_registered():
    import coverage_map as cov
    from tillbook.oracle_sql import ORACLE
    from tillbook.registry import QUERIES
    ids = set()
    for key in QUERIES:
        m = re.match(r"([a-z]+)(\d+)_", key)
        assert m, key
        ids.add((m.group(1) + m.group(2)).upper())
    missing = [op for op in cov.IDS if op not in ids and op != "SRC3"]
    assert missing == []
    assert set(QUERIES) == set(ORACLE) & set(QUERIES)
