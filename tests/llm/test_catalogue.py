import os

import pytest

from quarterlight.llm import queries as catalogue

from ..catalogue_check import DATA, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
KEYS = {"op3": ("pages", "page_id"), "op8": ("pages", "page_id")}


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_covers_its_table(spark, name):
    source, key = KEYS.get(name.split("_")[0], ("documents", "doc_id"))
    got = catalogue.queries()[name](spark, DATA).select(key).distinct().count()
    assert got == spark.read.parquet(f"{DATA}/{source}.parquet").count()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.queries()) == list(range(1, 14))
