import pytest

import __spark_entry__
from plumbline.llm.registry import ORACLES, QUERIES

from ..oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01") > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_all_rows(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    id, rows = ("vec_id", 500) if name == "op13_whitening" else ("doc_id", 200)
    assert df.select(id).distinct().count() == rows


def test_entry_has_all():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
