import pytest
from compare import same_rows

from engram.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf, name):
    same_rows(QUERIES[name](spark, sf), duck, ORACLE_SQL[name])


def test_every_operator_is_registered():
    import __spark_entry__ as e

    found = e.queries()
    assert all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 14)) and "pipeline" in found
