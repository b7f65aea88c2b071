"""Every registered query of the engine against its SQL."""

import pytest

from textloom.plans import catalog, load

from .compare import same
from .conftest import SF

load()


EMPTY = {"empty_embeddings", "kv_pairs"}  # nothing of the kind in the smallest tables; the cases of these rules have rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        same(df, duck, catalog.SQL[name])
    if name not in EMPTY:
        assert df.limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
