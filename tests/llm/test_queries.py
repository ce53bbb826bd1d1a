import pytest

from meibo.llm import queries
from tests.test_oracle import duck, norm  # noqa: F401

COLUMNS = {"p4_found": ["organization_id", "group_id"], "p5_found": ["segment_id", "text_field", "noise_kind"], "p6_found": ["field_name", "raw_value", "term_id"], "p7_found": ["kind", "key_a", "key_b"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert df.columns == COLUMNS.get(name, df.columns)
    if name.endswith("_found"):
        assert rows and len(set(map(tuple, rows))) == len(rows)
    if name in queries.SQL:
        want = sorted((tuple(norm(x) for x in r) for r in duck.execute(queries.SQL[name]).fetchall()), key=repr)
        assert sorted((tuple(norm(x) for x in r) for r in rows), key=repr) == want


def test_nothing_else_needs_this_package():
    import pathlib

    root = pathlib.Path(queries.__file__).parent.parent
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert "meibo.llm" not in p.read_text(encoding="utf-8")
