import pytest

from compare import check
from lamina.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    if name in catalogue.SQL:
        check(spark, catalogue.QUERIES[name], catalogue.SQL[name])
    else:
        from compare import SF

        assert catalogue.QUERIES[name](spark, SF).count() > 0
