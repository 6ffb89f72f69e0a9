import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplemark.operators import configs, services
from tests.conftest import rows

FILES = "path string, content string"


def facts(frame, path, content):
    df = configs.config_facts(frame(FILES, (path, content)))
    return {r.key: (r.value, r.value_type) for r in df.collect()}


def test_properties(frame):
    text = "# c\n! d\na=1\n b : x:y\r\nnoline\n\na=2=3\nq=\u00a0\n=v\n"
    assert facts(frame, "x.properties", text) == {
        "a": ("2=3", "string"), "b": ("x:y", "string"), "q": ("", "string"), "": ("v", "string"),
    }


def test_env(frame):
    text = "A=1\nB=\"x y\"\n#c\nC='y\"\nD=\"\nE=a=b\nA=9\n!F=1\nnone\n"
    assert facts(frame, "prod.env", text) == {
        "A": ("9", "string"), "B": ("x y", "string"), "C": ("'y\"", "string"), "D": ('"', "string"),
        "E": ("a=b", "string"), "!F": ("1", "string"),
    }
    assert facts(frame, "a/.env", "A=1") == {}  # no suffix, no reader


def test_js(frame):
    text = (
        "const x = 1;\nmodule.exports = { port: Number(process.env.P || 8102), name: 'svc', // note: 'x'\n"
        " nested: { rate: 1.50, on: true, off: null }, q: \"true\", n: 007, /* gone: 1 */ \"quoted\": 2 };\n"
    )
    assert facts(frame, "web/app.config.js", text) == {
        "name": ("svc", "string"), "rate": ("1.5", "float"), "on": ("true", "bool"), "off": (None, "null"),
        "q": ("true", "bool"), "n": ("7", "int"),
    }
    assert facts(frame, "x.config.ts", "export default { a: 1 }") == {}
    assert facts(frame, "x.mjs", "let y = { a: '' } + z") == {"a": ("", "string")}


def test_json(frame):
    text = '{"a":{"b":1,"c":[1,{"x":2}],"e":{}},"d":null,"s":"x{","t":true,"f":1.5}'
    assert facts(frame, "a.json", text) == {
        "a.b": ("1", "int"), "a.c": ('[1,{"x":2}]', "list"), "d": (None, "null"), "s": ("x{", "string"),
        "t": ("true", "bool"), "f": ("1.5", "float"),
    }
    assert facts(frame, "a.json", "[1, 2]") == {}
    assert facts(frame, "a.json", "{broken") == {}


def test_json_at_any_depth(frame):
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}}}'
    assert facts(frame, "a.json", deep) == {"a.b.c.d.e.f.g": ("1", "int")}
    assert facts(frame, "a.json", '{"a":1,"a":2}') == {"a": ("2", "int")}  # the last one wins


def test_json_literals_read_alike_at_any_depth(frame):
    literals = {
        "1.0": ("1.0", "float"), "-0.0": ("-0.0", "float"), "1E-7": ("1e-07", "float"), "1e400": ("inf", "float"),
        "12345678901234567.25": ("1.2345678901234568e+16", "float"), "123456789012345678901234567890": ("123456789012345678901234567890", "int"),
        '[{"b":1,"a":[2.0,{"d":1,"c":2}]}]': ('[{"a":[2,{"c":2,"d":1}],"b":1}]', "list"),
    }
    for depth in (1, 7, 50):
        text = "".join('{"k":' for _ in range(depth)) + "{" + ",".join(f'"x{i}":{t}' for i, t in enumerate(literals)) + "}" + "}" * depth
        key = "k." * depth
        assert facts(frame, "a.json", text) == {f"{key}x{i}": v for i, v in enumerate(literals.values())}


def test_colliding_keys(frame):
    assert facts(frame, "a.json", '{"a.b":1,"a":{"b":2}}') == {"a.b": ("2", "int")}
    assert facts(frame, "a.json", '{"a":{"b":2},"a.b":1}') == {"a.b": ("1", "int")}
    one = configs.config_facts(frame(FILES, ("a.json", '{"a.b":1,"a":{"b":2}}')))
    assert configs.config_changes(one, one).count() == 0


def test_order_and_form_in_lists_is_no_change(frame):
    old = configs.config_facts(frame(FILES, ("a.json", '{"l":[{"a":1,"b":2}]}')))
    new = configs.config_facts(frame(FILES, ("a.json", '{"l":[{"b":2,"a":1.0}],"deep":{"a":{"b":{"c":{"d":{"e":{"f":null}}}}}}}')))
    assert configs.config_changes(old, new).count() == 0


def test_odd_texts_cost_no_other_file(frame):
    odd = {
        "date.yaml": "a: [{2024-01-01: x}]", "self.yaml": "a: &x [*x]", "loop.yaml": "&x {a: 1, b: *x}", "bad.yaml": "a: [",
        "half.json": '{"a":"\\ud800","b":1}', "deep.json": "[" * 100_000, "bad.json": "{", "keys.yaml": "[1, 2]: x\n", "bad.xml": "<a", "none.yaml": None,
        "laugh.yaml": "a: &a {x: 1, y: 2}\nb: &b {x: *a, y: *a}\nc: &c {x: *b, y: *b}\nd: {x: *c, y: *c}\n",
    }
    files = frame(FILES, *odd.items(), ("ok.yaml", "a: 1"))
    found = {}
    for r in configs.config_facts(files).collect():
        found.setdefault(r.path, {})[r.key] = r.value
    assert found.pop("ok.yaml") == {"doc0/doc0.a": "1"}
    assert found.pop("half.json") == {"a": "\ufffd", "b": "1"}
    assert found.pop("date.yaml") == {"doc0/doc0.a": '[{"2024-01-01":"x"}]'}
    assert len(found.pop("laugh.yaml")) == 2 + 4 + 8 + 16
    assert found == {}
    assert {r.path for r in configs.manifest_services(files).collect()} == set()


def test_a_missing_library_is_loud(monkeypatch):
    import builtins

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ImportError(name)) if name == "yaml" else real(name, *a, **k))
    with pytest.raises(ImportError):
        list(configs._rows_of("a.yaml", "yaml", "a: 1"))


def test_aliases_are_read_lazily():
    """2^40 leaves: the first ones come at once."""
    text = "a0: &a0 {x: 1, y: 2}\n" + "".join(f"a{i}: &a{i} {{x: *a{i - 1}, y: *a{i - 1}}}\n" for i in range(1, 40))
    rows = configs._rows_of("a.yaml", "yaml", text)
    assert [next(rows)[1] for _ in range(3)] == ["doc0/doc0.a0.x", "doc0/doc0.a0.y", "doc0/doc0.a1.x.x"]


trees = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.text("ab{}[]\"\\:,é ", max_size=6),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("kxyz", min_size=1, max_size=3), inner, max_size=4),
    max_leaves=12,
)


@settings(max_examples=12, deadline=None)
@given(st.lists(trees, min_size=1, max_size=8))
def test_json_equals_the_plain_reader(spark, values):
    texts = [json.dumps(v) for v in values]
    df = spark.createDataFrame([(f"{i}.json", t) for i, t in enumerate(texts)], FILES)
    got = {(r.path, r.key, r.value, r.value_type) for r in configs.config_facts(df).collect() if r.value_type != "list"}
    want = set()
    for i, text in enumerate(texts):
        for key, value in dict(configs._json_facts(text)).items() if isinstance(json.loads(text), dict) else ():
            typed = configs._typed(value)
            if typed[1] != "list":
                want.add((f"{i}.json", key, *typed))
    assert got == want


YAML = """
kind: Deployment
metadata:
  name: cartservice
spec:
  replicas: 3
  template:
    spec:
      containers:
        - name: main
          env:
            - name: PEER
              value: "emailservice:8080"
            - name: OTHER
              value: not a host
---
a: 1.5
b: null
c: yes
---
- just a list
---
metadata: plain
"""


def test_yaml(frame):
    got = facts(frame, "k/deploy.yml", YAML)
    assert got["Deployment/cartservice.spec.replicas"] == ("3", "int")
    assert got["Deployment/cartservice.spec.template.spec.containers"][1] == "list"
    assert got["doc1/doc1.a"] == ("1.5", "float")
    assert got["doc1/doc1.b"] == (None, "null")
    assert got["doc1/doc1.c"] == ("true", "bool")
    assert got["doc3/doc3.metadata"] == ("plain", "string")
    assert facts(frame, "bad.yaml", "a: [") == {}


def test_xml(frame):
    text = "<c a='1'><s><t> 30 </t><e/></s><s><t>31</t></s></c>"
    assert facts(frame, "m.xml", text) == {"c.s.t": ("31", "string"), "c.s.e": ("", "string")}
    assert facts(frame, "m.xml", "<r>x</r>") == {"r": ("x", "string")}
    assert facts(frame, "n.xml", "<r xmlns='u'><v>1</v></r>") == {"{u}r.{u}v": ("1", "string")}
    assert facts(frame, "m.xml", "<broken>") == {}


def test_no_reader_for_python(frame):
    assert facts(frame, "config/auth_config.py", "PORT = 1") == {}


def test_manifest_services(frame):
    files = frame(FILES, ("k.yaml", YAML), ("k.json", "{}"), ("odd.yaml", "spec: {template: {spec: {containers: 5}}}"))
    assert rows(configs.manifest_services(files)) == [("k.yaml", "cartservice"), ("k.yaml", "emailservice")]


def test_changes_compare_with_type(frame):
    old = configs.config_facts(
        frame(FILES, ("a.json", '{"same":1,"num":30,"gone":1,"nul":null,"one":1,"flag":true,"text":"x"}'))
    )
    new = configs.config_facts(
        frame(FILES, ("a.json", '{"same":1,"num":"30","new":2,"one":1.0,"flag":1,"text":"y"}'))
    )
    got = rows(configs.config_changes(old, new), "key", "old_value", "new_value")
    assert got == [("gone", "1", None), ("new", None, "2"), ("num", "30", "30"), ("text", "x", "y")]


def test_documented_change(frame):
    fact = "path string, key string, value string, value_type string"
    old = frame(fact, ("p", "server.timeout", "30", "int"), ("p", "retry.attempts", "3", "int"))
    new = frame(fact, ("p", "server.timeout", "60", "int"), ("p", "retry.attempts", "3", "int"))
    assert rows(configs.config_changes(old, new), "key", "old_value", "new_value") == [("server.timeout", "30", "60")]
    assert rows(configs.key_union(old, new), "key") == [("retry.attempts",), ("server.timeout",)]


def test_services_in_keys(frame):
    keys = frame(
        "key string", "Deployment/shippingservice.spec.x", "Service/cart.y", "StatefulSet/.z", "a.b", "XService/q"
    )
    assert rows(services.services_in_keys(keys)) == [("cart",), ("q",), ("shippingservice",)]


@pytest.mark.parametrize(
    "line, found",
    [
        ("name: checkoutservice", ["checkoutservice"]),
        ('app: "my-cart"', ["my-cart"]),
        ("value: my-frontend-proxy, name: 'authservice'", ["my-frontend-proxy", "authservice"]),
        ("name: frontend", []),  # a letter must precede the word
        ("name: Checkoutservice", []),
        ("title: checkoutservice", []),
    ],
)
def test_mentions(frame, line, found):
    got = services.service_mentions(frame("path string, line string", ("p", line)))
    assert rows(got, "service") == sorted((s,) for s in found)


def test_tests_of_a_config_change(frame):
    from ripplemark.plans.config_selection import tests_of_config_change

    old = frame(FILES, ("a.json", '{"server":{"timeout":30},"retry":3}'), ("b.env", "HOST=a"))
    new = frame(FILES, ("a.json", '{"server":{"timeout":60},"retry":3}'), ("b.env", "HOST=a"))
    access = frame("test_id string, config_key string", ("T1", "server.timeout"), ("T1", "retry"), ("T2", "HOST"))
    assert rows(tests_of_config_change(old, new, access)) == [("T1", "server.timeout")]


def test_deep_lists_lose_no_settings(frame):
    """A list of any depth that the reader takes is one setting; none of its neighbours is lost."""
    for depth in (500, 1500):
        text = '{"a":1,"b":' + "[" * depth + "]" * depth + ',"c":2}'
        got = {r.key: r.value for r in configs.flatten_json(frame("path string, content string", ("f.json", text))).collect()}
        assert got in ({}, {"a": "1", "b": "[" * depth + "]" * depth, "c": "2"})
        assert depth > 500 or got
    assert configs._printed([{"b": {2: 1.0}, "a": {"y", "x"}}, [None, True, (1.5, "é")]]) == '[{"a":["x","y"],"b":{"2":1}},[null,true,[1.5,"é"]]]'


def test_changes_of_files_read_each_pair_of_texts_once(frame, monkeypatch):
    """Equal to the comparison of all settings; files of equal texts are not read, copies of a pair are read once."""
    old = [(f"a{i}.json", '{"x": 1, "y": 2}') for i in range(50)] + [("same.yaml", "k: 1"), ("gone.env", "A=1"), ("none.json", None)]
    new = [(f"a{i}.json", '{"x": 1, "y": 3}') for i in range(50)] + [("same.yaml", "k: 1"), ("come.properties", "a=1\nb=2"), ("none.json", '{"z": 0}')]
    old += [("b.yaml", "kind: K\nv: 1"), ("b.xml", "<r><a>1</a></r>"), ("b.json", '{"x": 1, "y": 2}'), ("b.js", "x = {y: 2}"), ("b.txt", "A=1")]
    new += [("b.yaml", "kind: K\nv: 1.0"), ("b.xml", "<r><a>2</a></r>"), ("b.json", '{"x": 1}'), ("b.js", "x = {y: 3}"), ("b.txt", "A=2")]
    before, after = (frame("path string, content string", *rows_) for rows_ in (old, new))
    want = rows(configs.config_changes(configs.config_facts(before), configs.config_facts(after)))
    read = []
    known = configs._facts_of_known
    monkeypatch.setattr(configs, "_facts_of_known", lambda files: (read.append(files.count()), known(files))[1])
    assert rows(configs.file_changes(before, after)) == want and len(want) == 57
    assert read == [8, 8]
    assert set(rows(configs.distinct_changes(before, after))) == {r[1:] for r in want}
