"""Every registered core query against its SQL on the small tables; outcomes without rows are named."""

import pytest
from oracle import DATA, compare, connect

from strataloom.plans.registry import collect

QUERIES, ORACLES = collect()
FOLDER = f"{DATA}/sf0.01"
#: No case of these in the small tables; made cases stand in test_operators.py and test_whole_pairs.py.
EMPTY = {"duplicate_keys", "same_component_pairs", "invalid_spans", "injection_flags", "newest_prior"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, FOLDER, QUERIES[name], ORACLES[name]) or name in EMPTY
    else:
        QUERIES[name](spark, FOLDER).count()
