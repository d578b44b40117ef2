from __future__ import annotations

import pytest

from compare import differences
from vecspark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], sf_dir) == []


def test_approximate_search_keeps_its_recall(spark, sf_dir):
    from vecspark.operators import search

    own = catalog.embeddings(spark, sf_dir)
    exact = search.search_batch(own, catalog.as_queries(own), 10).persist()
    for name in ("ann_ivf", "ann_graph"):
        row = search.quality(search.recall(catalog.queries()[name](spark, sf_dir), exact)).first()
        assert row["mean_recall"] >= 0.9, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
