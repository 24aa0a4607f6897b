import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.operators import shred
from sedimenta.plans import problems

LAYOUT = {"a": [{"x": None, "b": [{"y": None, "c": [{"z": None}]}]}], "o": {"p": None, "q": [{"r": None}]}}


def brute(value, layout):
    """Rows (path, parent_pos, pos) by walking the record."""
    out = []

    def opened(v):
        while isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return None
        return v

    def walk(v, node, path, parent):
        v = opened(v)
        if not isinstance(v, dict):
            return
        for name, child in node.items():
            w = opened(v.get(name))
            if isinstance(child, list):
                items = [w] if isinstance(w, dict) else w if isinstance(w, list) else []
                for i, item in enumerate(items):
                    if isinstance(opened(item), dict):
                        out.append((".".join((*path, name)), parent, i))
                        walk(item, child[0], (*path, name), i)
            elif isinstance(child, dict):
                walk(w, child, (*path, name), parent)

    walk(value, layout, (), -1)
    return sorted(out)


def rebuilt(values, layout):
    records = pa.array([shred.parse_payload(v, layout) for v in values], type=shred.arrow_type(layout))
    stripes = shred.stripe(records, layout)
    out = []
    for node in shred.list_nodes(layout):
        flat = shred.rebuild(stripes, node)
        out += [(r, ".".join(node.path), p, i) for r, p, i in zip(flat["record"], flat["parent_pos"], flat["pos"])]
    return sorted(out)


leaf = st.one_of(st.none(), st.text(max_size=3), st.integers(), st.booleans(), st.floats(allow_nan=False, allow_infinity=False))
c = st.one_of(st.none(), leaf, st.fixed_dictionaries({}, optional={"z": leaf}))
b = st.one_of(leaf, st.fixed_dictionaries({}, optional={"y": leaf, "c": st.one_of(leaf, st.lists(c, max_size=3), c)}))
a = st.one_of(leaf, st.fixed_dictionaries({}, optional={"x": leaf, "b": st.one_of(leaf, st.lists(b, max_size=3), b)}))
record = st.one_of(leaf, st.fixed_dictionaries({}, optional={"a": st.one_of(leaf, st.lists(a, max_size=3), a), "o": st.one_of(leaf, st.fixed_dictionaries({}, optional={"q": st.lists(c, max_size=2)}))}))


@settings(max_examples=150, deadline=None)
@given(st.lists(record, max_size=4))
def test_rebuilt_tables_equal_a_walk_of_the_records(values):
    texts = [json.dumps(v) for v in values]
    expected = sorted((i, *row) for i, t in enumerate(texts) for row in brute(t, LAYOUT))
    assert rebuilt(texts, LAYOUT) == expected


def test_levels_of_a_known_record():
    layout = {"a": [{"x": None, "b": [{"y": None}]}]}
    text = json.dumps({"a": [{"x": "1", "b": [{"y": "p"}, None]}, None, {"b": []}]})
    stripes = shred.stripe(pa.array([shred.parse_payload(text, layout)], type=shred.arrow_type(layout)), layout)
    assert stripes["a", "x"].rep.tolist() == [0, 1, 1]
    assert stripes["a", "x"].level.tolist() == [4, 2, 3]
    assert stripes["a", "b", "y"].rep.tolist() == [0, 2, 1, 1]
    assert stripes["a", "b", "y"].level.tolist() == [7, 5, 2, 4]
    assert stripes["a", "b", "y"].values.to_pylist() == ["p", None, None, None]


def test_odd_payloads():
    bad = [None, "", "{", "NaN", '{"a": NaN}', "[1]", "null", '"', "5", '"5"', "﻿{}"]
    assert rebuilt(bad, LAYOUT) == []
    nested = "[" * 5000 + "]" * 5000
    assert rebuilt([nested], LAYOUT) == []
    text = json.dumps(json.dumps({"a": json.dumps([{"x": 10**50}, json.dumps({"x": "\ud800"}), "7"])}))
    assert rebuilt([text], LAYOUT) == [(0, "a", -1, 0), (0, "a", -1, 1)]


def test_spark_tables_and_links(spark):
    rows = [(1, json.dumps({"a": [{"x": "u", "b": [{"y": "v"}]}, {"x": "w"}]}), "p"), (1, None, "q"), (None, '{"a": {"x": "1"}}', None)]
    df = spark.createDataFrame(rows, "id bigint, j string, record_key string")
    flat = shred.shred(df, "id", "j", LAYOUT)
    assert sorted((r["path"], r["parent_pos"], r["pos"]) for r in flat.where("record_key = 1").collect()) == [("a", -1, 0), ("a", -1, 1), ("a.b", 0, 0)]
    assert [tuple(r) for r in shred.flat_table(flat, LAYOUT, "a.b").collect()] == [(1, 0, 0, "v")]
    assert shred.shred(df.limit(0), "id", "j", LAYOUT).count() == 0


def test_typed_records_with_slices(spark):
    typed = spark.createDataFrame([(i, [None, {"x": str(i), "b": [{"y": "k"}] * (i % 3)}]) for i in range(50)], "id bigint, a array<struct<x:string,b:array<struct<y:string>>>>")
    layout = {"a": [{"x": None, "b": [{"y": None}]}]}
    out = shred.shred(typed, "id", ["a"], layout, with_fields=False).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in out} == {"a": 50, "a.b": sum(i % 3 for i in range(50))}


def test_ingredients_of_both_sources(spark, sf_dir, tmp_path):
    kind = "record_id bigint, products array<struct<product_number:string,brand_name:string,dosage_form:string,route:string,marketing_status:string,active_ingredients:array<struct<name:string,strength:string>>>>, submissions array<struct<submission_type:string,submission_number:string,submission_status:string,submission_status_date:string,submission_class_code_description:string,application_docs:array<struct<id:string,date:string,type:string>>>>"
    spark.createDataFrame([(3, [("1", "Brand", None, None, None, [("x", "5")])], None)], kind).write.parquet(f"{tmp_path}/openfda_drugsfda.parquet")
    payload = {"products": [{"product_number": "1"}, {"product_number": "2", "brand_name": "Other", "active_ingredients": [{"name": "y"}, 7, {"name": "z", "strength": "1 MG"}]}]}
    spark.createDataFrame([(4, json.dumps(payload)), (5, None), (6, "{")], "doc_id bigint, structured string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("source_table", "record_key", "product_number", "brand_name", "pos", "name", "strength")
    got = sorted(map(tuple, problems.p1_ingredients_all(spark, str(tmp_path)).select(*columns).collect()))
    assert got == [("documents", 4, "2", "Other", 0, "y", None), ("documents", 4, "2", "Other", 2, "z", "1 MG"), ("openfda_drugsfda", 3, "1", "Brand", 0, "x", "5")]
    links = ("source_table", "record_key", "pos")
    found = problems.p1_found(spark, sf_dir).where("path = 'products.active_ingredients'").select(*links)
    assert sorted(map(tuple, problems.p1_ingredients_all(spark, sf_dir).select(*links).collect())) == sorted(map(tuple, found.collect()))
