import json

from meibo.functions.jsonfix import BROKEN, NOTHING, parse_answer
from meibo.operators.variants import CAREER, EDUCATION, RELATIVE, flatten, nested_nodes, role_of, state_of, subtype_table, variant_catalogue

REL = [{"name": "a", "education": [0, {"institution": "x"}], "career": {"job_title": "t"}, "family_member": [{"name": "b", "family_member": {"name": "c", "education": None}}]}, None, "不詳", {"relation": "父"}]


def paths(text):
    v = parse_answer(text)
    return [] if v is BROKEN or v is NOTHING else [(r["parent_path"], r["node_path"]) for r in flatten(1, v)]


WANT = [("", "f0"), ("f0", "f0/f0"), ("f0/f0", "f0/f0/f0"), ("f0", "f0/e1"), ("f0", "f0/c0"), ("", "f3")]


def test_every_form_gives_the_same_nodes():
    plain = json.dumps(REL, ensure_ascii=False)
    forms = [plain, json.dumps(REL), json.dumps(REL, indent=1), "```json\n" + plain + "\n```", "以下の通り:\n" + plain + "\n以上", "<think>see [1] {x}</think>\n" + plain, json.dumps(plain), repr(REL), "﻿  " + plain + "\n\n", json.dumps({"family_member": REL}), "```\n" + repr({"family_member": REL}) + "\n```"]
    for f in forms:
        assert paths(f) == WANT, f
    inner = [dict(REL[0], family_member=json.dumps(REL[0]["family_member"])), *REL[1:]]
    assert paths(json.dumps(inner)) == WANT


def test_broken_and_empty_answers():
    plain = json.dumps(REL)
    assert all(paths(plain[:n]) == [] for n in range(len(plain)))
    assert [paths(x) for x in (None, "", "  ", "null", "[]", "[null]", "none given", "{}", "<think>no end")] == [[], [], [], [], [], [], [], [("", "f0")], []]


def test_single_object_and_depth():
    assert paths('{"name": "a"}') == [("", "f0")]
    deep = '{"name":"x","family_member":[' * 3000 + "1" + "]}" * 3000
    got = paths(deep)
    assert len(got) == 3000 and got[-1][1].count("/") == 2999
    assert state_of(RELATIVE, {"k": [1.5, "a", None, True, {}, []], "a": {"b": 1}}) == "relative{a:{},k:[[]|flag|null|number|text|{}]}"
    rows = {r["node_path"]: r for r in flatten(1, REL)}
    assert rows["f0/e1"]["variant"] == "education{institution:text}" and all(role_of(r["variant"]) == r["kind"] for r in rows.values())


def test_tables_route_by_subtype(spark):
    rows = [(1, json.dumps(REL), "x", 1), (2, None, "x", 1), (3, "[{", "x", 1), (None, json.dumps(REL), "x", 1), (4, json.dumps([{"name": ["n"], "birth_year": "1900", "x": 1}]), "x", 1), (1, json.dumps(REL), "x", 1)]
    nodes = nested_nodes(spark.createDataFrame(rows, "bio_id long, family_member string, kind string, depth int"))
    assert nodes.count() == 13
    rel = {(r.bio_id, r.node_path): r for r in subtype_table(nodes, RELATIVE).collect()}
    assert rel[(4, "f0")].name == "n" and rel[(4, "f0")].birth_year == 1900 and json.loads(rel[(4, "f0")].rest) == {"x": 1}
    assert {r.institution for r in subtype_table(nodes, EDUCATION).collect()} == {"x"} and {r.job_title for r in subtype_table(nodes, CAREER).collect()} == {"t"}
    assert sum(r.n_objects for r in variant_catalogue(nodes).collect()) == 13
    assert nested_nodes(spark.createDataFrame([], "bio_id long, family_member string")).count() == 0
