import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.operators import shred as H


def nodes(spark, docs, **k):
    df = spark.createDataFrame([(i, d, "noise") for i, d in enumerate(docs)], "id int, doc string, path string")
    return H.shred(df, ["id"], "doc", **k)


def brute(v, path="", above=""):
    """Array-element objects as (path, nearest enclosing one), recursively."""
    out = []
    if isinstance(v, dict):
        for k, w in v.items():
            out += brute(w, f"{path}.{k}" if path else k, above)
    elif isinstance(v, list):
        for i, w in enumerate(v):
            here = f"{path}[{i}]"
            if isinstance(w, dict):
                out.append((here, above))
                out += brute(w, here, here)
            else:
                out += brute(w, here, above)
    return out


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), c, max_size=3), max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(JSON)
def test_walk_equals_recursion(value):
    text = json.dumps(value)
    got = [(n[1 - 1], n[2]) for n in H._nodes(H._parsed(text), "") if n[6] == "object" and n[3]]
    assert got == brute(value)
    assert H._deep(text) == H._parsed(text)


def test_paths_and_links(spark):
    doc = '{"a": {"b": [{"c": [1, {"x": 1.50}]}, null, "s"]}, "g": [[0, {"y": "[1]"}]]}'
    got = {r["path"]: (r["parent"], r["parent_path"], r["entity"], r["kind"], r["scalar"]) for r in nodes(spark, [doc]).collect()}
    assert got["a.b[0]"] == ("a.b", "", "a.b[]", "object", None)
    assert got["a.b[0].c[1]"] == ("a.b[0].c", "a.b[0]", "a.b[].c[]", "object", None)
    assert got["g[0][1]"] == ("g[0]", "", "g[][]", "object", None)
    assert got["a.b[0].c[1].x"][3:] == ("number", "1.50") and got["g[0][1].y"][3:] == ("string", "[1]") and got["a.b[1]"][3] == "null"


def test_bad_and_odd_documents(spark):
    deep = "[" * 30_000 + "{}" + "]" * 30_000
    huge = '[{"n": ' + "9" * 6000 + "}]"
    docs = [None, "", " ", "{", '{"a": NaN}', "[{}] x", '[{"a": "\\ud800"}]', huge, deep, '[{"k": 1, "k": 2}]', "[{}]\n", '["{}"]', "\ufeff[]", "[01]", '["\t"]']
    got = {}
    for r in nodes(spark, docs, kinds=("object",)).collect():
        got.setdefault(r["id"], []).append(r["path"])
    assert {k: len(v) for k, v in got.items()} == {6: 1, 7: 1, 8: 1, 9: 1, 10: 1}


def put_together(rows):
    """The record that its entity rows came from."""

    def steps(place):
        out, key, i = [], None if place[:1] == "[" else "", 0
        while i < len(place):
            if place[i] == "[":
                if key is not None:
                    out.append(key)
                end = place.index("]", i)
                out.append(int(place[i + 1 : end]))
                key, i = None, end + 1
            elif place[i] == ".":
                if key is not None:
                    out.append(key)
                key, i = "", i + 1
            else:
                i += place[i] == "\\"
                key, i = (key or "") + place[i], i + 1
        return out if key is None else [*out, key]

    tree = {}

    def at(way, value):
        here = tree
        for step in way[:-1]:
            here = here.setdefault(step, {})
        here.setdefault(way[-1], {}).update(value) if isinstance(value, dict) else here.__setitem__(way[-1], value)

    typed = lambda kind, x: x if kind == "string" else ("[]", "{}").index(x) if x in ("[]", "{}") else json.loads(x or "null")
    ways = {"": ("root",)}
    for r in sorted(rows, key=lambda r: r["path"].count("[")):
        way = ways[r["parent_path"]] + tuple(steps(r["place"])) if r["path"] else ways[""]
        ways.setdefault(r["path"], way)
        if r["kind"] == "object":
            at(way, {})
            for k, x in r["fields"].items():
                kind = r["kinds"][k]
                empty = {"array": [], "object": {}}.get(kind)
                at(way + tuple(steps(k)), {"(empty)": empty} if empty is not None else typed(kind, x) if kind != "null" else None)
        else:
            x = r["fields"]["value"]
            at(way, {"(empty)": []} if r["kind"] == "array" else typed(r["kind"], x) if r["kind"] != "null" else None)

    def plain(x):
        if not isinstance(x, dict):
            return x
        if "(empty)" in x:
            return x["(empty)"]
        if x and all(isinstance(k, int) for k in x):
            return [plain(x[i]) for i in range(len(x))]
        return {k: plain(v) for k, v in x.items()}

    return plain(tree.get("root", {}))


def test_records_can_be_put_together_again(spark, data):
    doc = {"x": [{"id": 1, "meta": {"k": "v", "a.b": {"[c": None}}, "tags": ["a", "b", None, []], "n": None, "e": {}}, {}], "top": "root", "list": [], "m": [[1, {"y": "2"}], [[]]], "w\\.": True}
    docs = [json.dumps(d) for d in (doc, [], {}, 5, "s", None, [1, [2]], [{}], {"": {"": 1.5}})]
    runs = spark.read.parquet(f"{data}/run_results.parquet").selectExpr("explode(stages) AS (k, b)").selectExpr("b.evidence AS e").where("e IS NOT NULL").distinct().toPandas()["e"]
    for e in runs:
        try:
            json.loads(e)
            docs.append(e)
        except ValueError:
            pass
    rows = {}
    for r in H.entity_rows(nodes(spark, docs), ["id"]).collect():
        rows.setdefault(r["id"], []).append(r)
    assert len(docs) > 30
    for i, d in enumerate(docs):
        assert put_together(rows[i]) == json.loads(d), d


def test_nothing_of_an_object_is_lost(spark):
    doc = '{"x":[{"id":1,"meta":{"k":"v"},"tags":["a","b"],"n":null}],"top":"root"}'
    got = {r["path"]: (r["entity"], r["parent_path"], r["fields"]) for r in H.entity_rows(nodes(spark, [doc]), ["id"]).collect()}
    assert got == {
        "": ("", "", {"top": "root"}), "x[0]": ("x[]", "", {"id": "1", "meta.k": "v", "n": None}), "x[0].tags[0]": ("x[].tags[]", "x[0]", {"value": "a"}), "x[0].tags[1]": ("x[].tags[]", "x[0]", {"value": "b"}),
    }
    j = H.entity_rows(nodes(spark, [doc]), ["id"]).where("path = 'x[0]'").select(H.fields_json().alias("j")).first()["j"]
    assert j == '{"id":1,"meta.k":"v","n":null}'


def test_entities(spark):
    docs = ['{"a": [{"x": 1, "path": "p", "b": [{"y": true}]}, {}]}'] * 2
    df = spark.createDataFrame([(1, d) for d in docs], "id int, doc string")
    n = H.shred(df, ["id"], "doc")
    e = {r["path"]: r for r in H.entity_rows(n, ["id"]).collect()}
    assert e["a[0]"]["fields"] == {"x": "1", "path": "p"} and e["a[1]"]["fields"] == {} and e["a[0].b[0]"]["parent_path"] == "a[0]"
    t = H.entity_table(n, ["id"], "a[]")
    assert t.columns == ["id", "path", "parent_path", "ordinal", "f_path", "x"] and e[""]["fields"] == {}
    assert sorted((r["path"], r["x"]) for r in t.collect()) == [("a[0]", "1"), ("a[1]", None)]
    with pytest.raises(ValueError):
        H.entity_table(n, ["id"], "a[]", most=1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, doc string")
    assert H.shred(df, ["id"], "doc").count() == 0 and H.entity_rows(H.shred(df, ["id"], "doc"), ["id"]).count() == 0
