"""The one merge of JSON texts, by value, and the upsert on it."""

import json

import pytest
from entitymill.operators import mapping, merge
from entitymill.operators.jsontree import Merged, merge_texts

CASES = [
    ('{"wo":"1"}', '{"wo":"2"}', '{"wo":["1","2"]}'),
    ('{"a":"x"}', '{"a":null}', '{"a":["x",null]}'),
    ('{"a":null}', '{"a":5}', '{"a":[null,5]}'),
    ('{"a":{}}', '{"a":5}', '{"a":[{},5]}'),
    ('{"a":{"k":1}}', '{"a":{"m":2}}', '{"a":{"k":1,"m":2}}'),
    ('{"a":{"k":{"x":1,"y":null}}}', '{"a":{"k":{"x":2,"z":[1]}}}', '{"a":{"k":{"x":[1,2],"y":null,"z":[1]}}}'),
    ('{"a":1}', '{"a":1.0}', '{"a":1.0}'),
    ('{"a":1}', '{"a":true}', '{"a":[1,true]}'),
    ('{"a":100}', '{"a":1e2}', '{"a":1e2}'),
    ('{"a":12345678901234567890}', '{"a":12345678901234567891}', '{"a":[12345678901234567890,12345678901234567891]}'),
    ('{"a":[1,{"x":1,"y":2}]}', '{"a":[1.0,{"y":2,"x":1}]}', '{"a":[1.0,{"x":1,"y":2}]}'),
    ('{"a":1,"a":2}', "{}", '{"a":2}'),
    ('{"a":1,"a":2}', '{"a":2}', '{"a":2}'),
    ("", '{"b":1,"a":2}', '{"a":2,"b":1}'),
    (None, None, "{}"),
    ("{}", "", "{}"),
    ("no object", '{"a":1}', '{"a":1}'),
    ('{"a":1}', "[1]", '{"a":1}'),
    ("null", "[1]", "[1]"),
    ('{"a":NaN}', '{"b":1}', '{"b":1}'),
    ('{"a":"\\ud83d"}', '{"b":"ü\\n"}', '{"a":"�","b":"ü\\n"}'),
    ('{"":1}', '{"":{}}', '{"":[1,{}]}'),
]


@pytest.mark.parametrize("old, new, want", CASES)
def test_texts_merge(old, new, want):
    assert merge_texts(old, new) == want


def test_a_third_value_nests():
    m = Merged()
    for v in ("a", "b", "c", "c"):
        m.take('{"k":"%s"}' % v)
    assert m.text() == '{"k":[[["a","b"],"c"],"c"]}'


def test_many_conflicts_and_deep_texts():
    m = Merged()
    for i in range(4000):
        m.take('{"k":%d}' % i)
    assert m.text().startswith('{"k":' + "[" * 3999 + "0,1],2]")
    assert merge_texts('{"a":' + "[" * 50_000 + "]" * 50_000 + "}", '{"b":1}') == '{"b":1}'


def test_upserts_recurse(spark):
    """The batch merge, the keyed rows and a merge onto kept records give one result."""
    texts = ['{"a":{"k":1},"n":1}', '{"a":{"m":null},"n":1.0}', "", '{"a":{"k":2},"z":"x"}', "[]"]
    rows = spark.createDataFrame([("7", i, "N" if i == 1 else "", "", "bob" if i == 0 else "", t) for i, t in enumerate(texts)] + [("8", 9, "", "", "", "not json")], "id string, seq long, name string, alias_a string, alias_b string, extras string")
    want = '{"a":{"k":[1,2],"m":null},"n":1.0,"z":"x"}'
    got = {r.id: tuple(r)[1:] for r in merge.upsert_with_extras(rows).collect()}
    assert got == {"7": ("N", "", "bob", 5, want), "8": ("", "", "", 1, "not json")}
    kept = merge.upsert_with_extras(rows.where("seq < 2"))
    assert {r.id: tuple(r)[1:] for r in merge.upsert_with_extras(rows.where("seq >= 2"), kept).collect()} == got
    assert {r.id: r.merged for r in merge.merge_json(rows).collect()} == {"7": want, "8": "not json"}
    assert {(r.id, r.key): r.merged for r in merge.merge_json_keys(rows).collect()} == {("7", "a"): '{"k":[1,2],"m":null}', ("7", "n"): "1.0", ("7", "z"): '"x"'}


def test_records_with_repeated_keys(spark):
    lines = ['{"user_id":7,"city":"x","city":"y","n":1.50}', '{"user_id":"8","o":{"a":1,"a":2}}', '{"user_id":"9","city":"x"}']
    got = {r.id: json.loads(r.extras) for r in mapping.map_records(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")).collect()}
    assert got == {"7": {"city": "y", "n": 1.5}, "8": {"o": {"a": 2}}, "9": {"city": "x"}}
