"""Every query beside its reference SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from rubrika.plans.oracles import ORACLES
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with connect(SF_DIR) as con:
        yield con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_reference_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert df.columns, name
    assert not differences(df, contract.oracle_sql()[name], duck)


def test_only_iterative_fits_lack_sql():
    from rubrika.plans.catalog import QUERIES

    assert set(QUERIES) - set(contract.oracle_sql()) == {"predict_lr", "model_selection"}


def test_flagship(spark):
    assert contract.entry(spark).count() == 4
