"""Rules over small tables against results worked out by hand."""

import pytest

from textloom.plans.catalog import Tables
from textloom.shipping import ship

from .cases import CASES
from .compare import same
from .conftest import SF


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, duck, name):
    ship(spark)
    make, sql = CASES[name]
    same(make(Tables(spark, SF)), duck, sql)
