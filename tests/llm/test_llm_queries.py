"""Every query of the subpackage: SQL where there is one, columns and distinct rows otherwise."""

import pytest
from conftest import same_rows

from kgspark.llm import registry

FOUND = {
    "p1_found": {"src", "row_key", "pii_type"},
    "p2_found": {"src", "row_key", "defect"},
    "p3_found": {"zettel_id_a", "zettel_id_b"},
    "p4_found": {"tag_a", "tag_b"},
    "p5_found": {"user_id", "name_a", "name_b"},
    "p7_found": {"zettel_id_a", "zettel_id_b"},
    "p9_found": {"doc_id", "item_id"},
    "p10_found": {"doc_id", "kind"},
}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, data, duck, name):
    same_rows(registry.QUERIES[name](spark, data), duck, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    rows = df.collect()
    if name in FOUND:
        assert set(df.columns) == FOUND[name] and len(set(rows)) == len(rows) and rows
