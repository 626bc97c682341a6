import os

import pytest

from lodestrata.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {"p2_found": ["application_no", "field_name", "holder_id"], "p4_found": ["field_name", "id_a", "id_b"], "p5_found": ["field_name", "name_id_a", "name_id_b"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    # with a dozen ratings no document need be of the highest level
    assert df.count() > 0 or name == "p9_found"
