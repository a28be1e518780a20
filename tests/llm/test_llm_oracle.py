"""Every registered training-data query with SQL against DuckDB, whole tables of the small scale factor."""

import pytest

from conftest import SF_SMALL
from oracle_check import digest, duck_connect
from tillbook.llm.oracle import ORACLE
from tillbook.llm.queries import QUERIES


def test_all_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    found = duck_connect(SF_SMALL).execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    got = QUERIES[name](spark, SF_SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert digest(columns, found.fetchall()) == digest(columns, [tuple(r) for r in got.select(*columns).collect()])
