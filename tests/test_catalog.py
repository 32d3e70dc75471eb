"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from conftest import SF, compare
from termloom.plans import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        compare(df, duck, catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["cid", "locator", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_operators():
    """The other queries stay when the subpackage can't be imported."""
    import sys

    import __spark_entry__

    gone = {"termloom.llm": None, "termloom.llm.queries": None, "corpus_pipeline": None}
    kept = {k: sys.modules.get(k) for k in gone}
    parent = sys.modules["termloom"]
    attribute = parent.__dict__.pop("llm", None)
    sys.modules.update(gone)
    try:
        assert set(__spark_entry__.queries()) == set(catalog.QUERIES)
    finally:
        for k, v in kept.items():
            if v is None:
                sys.modules.pop(k, None)
            else:
                sys.modules[k] = v
        if attribute is not None:
            parent.llm = attribute
