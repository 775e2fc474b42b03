"""Every query of the library runs on the smallest tables."""

import pytest

from docgrove.plans import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_it_runs(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.count() >= (0 if name == "file_discovery" else 1) and len(set(found.columns)) == len(found.columns)
