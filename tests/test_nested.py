"""Flat tables of nested records against a plain walk."""

import json

from pyspark.sql import functions as F

from claimloom.operators import nested

WORK = {
    "author": [{"given": "A", "family": "B", "affiliation": [{"name": "U", "id": [{"id": "r1"}, None, {"id": "r2"}]}, None, "V"]}, None, "C D", {"name": "G", "affiliation": {"name": "W", "id": {"id": "r3"}}}],
    "published": {"date-parts": [[2020, 1, 2], [None], None, [2021]]},
    "link": [{"URL": "u1"}, {"x": 1}, "u2", None],
    "update-to": {"DOI": "d", "type": "t"},
}
EXPECTED = {
    ("author", "0"), ("author", "2"), ("author", "3"), ("affiliation", "0/0"), ("affiliation", "0/2"), ("affiliation", "3/0"), ("affiliation_id", "0/0/0"), ("affiliation_id", "0/0/2"), ("affiliation_id", "3/0/0"),
    ("published", "0"), ("published", "3"), ("link", "0"), ("link", "2"), ("update", "0"),
}


def rows(spark, payloads):
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "record_id long, payload string, path string")
    out = {}
    for r in nested.work_rows(df).collect():
        out.setdefault(r["record_id"], set()).add((r["child"], r["path"]))
    return out


def test_wrappings_and_kinds(spark):
    w = json.dumps(WORK)
    got = rows(spark, [w, json.dumps(w), json.dumps({"status": "ok", "message": WORK}), json.dumps(json.dumps({"message": w})), json.dumps([WORK]), w[:-5], "", None, "[]", "<html>", "null", "7", json.dumps({"message": None}), w])
    assert got == {i: EXPECTED for i in (0, 1, 2, 3, 4, 13)}


def test_single_values(spark):
    got = rows(spark, [
        json.dumps({"author": "X", "link": "u", "published": "2020-05-01", "update-to": []}),
        json.dumps({"author": {"family": "Y", "affiliation": "Z"}, "published": {"date-parts": [2020, 5]}, "link": None}),
        json.dumps({"published": {}, "author": [], "link": [None]}), json.dumps({"published": {"date-parts": [[None]]}}),
    ])
    assert got == {0: {("author", "0"), ("link", "0"), ("published", "0")}, 1: {("author", "0"), ("affiliation", "0/0"), ("published", "0")}}


def test_columns_and_parents(spark):
    df = spark.createDataFrame([(1, json.dumps(WORK))], "record_id long, payload string")
    t = nested.work_tables(df)
    ids = {r["path"]: (r["parent"], r["ordinal"], r["id"]) for r in t["affiliation_id"].collect()}
    assert ids["0/0/2"] == ("0/0", 2, "r2") and ids["3/0/0"] == ("3/0", 0, "r3")
    assert {(r["year"], r["month"], r["day"]) for r in t["published"].collect()} == {(2020, 1, 2), (2021, None, None)}
    assert t["author"].where("path = '2'").first()["name"] == "C D"


def test_schema_and_generic_children(spark):
    df = spark.createDataFrame([(1, '{"a b": [{"x": [1, null, 3]}], "s": 1}'), (2, '{"a b": {"x": 5}, "s": "t"}')], "k long, p string")
    r = nested.parse_records(df, "p")
    kinds = {(x["path"], x["kind"]) for x in nested.merged_schema(r).collect()}
    assert ("s", "BIGINT") in kinds and ("s", "STRING") in kinds and any(p == "a b.x" and k.startswith("ARRAY") for p, k in kinds)
    fields = nested.array_fields(nested.merged_schema(r))
    assert fields == ["a b", "a b.x"]
    t = nested.child_tables(r.select("k", "record"), "k", fields)
    got = {(x["k"], x["path"]) for x in t["a b.x"].select("k", "path").collect()}
    assert got == {(1, "0/0"), (1, "0/2"), (2, "0/0")}


def test_a_new_list_is_a_new_table(spark):
    works = [{"author": ["A"]}, {"author": [{"name": "B", "role": ["x", None, "y"]}], "assertion": [{"n": 1}, "two"], "it's.odd": [[1, 2], [3]]}]
    df = spark.createDataFrame([(i, json.dumps(w)) for i, w in enumerate(works)], "record_id long, payload string")
    rows = {(r["record_id"], r["child"], r["path"], r["parent"]) for r in nested.list_rows(df).collect()}
    assert rows == {
        (0, "author", "0", None), (1, "author", "0", None), (1, "author.role", "0/0", "0"), (1, "author.role", "0/2", "0"), (1, "assertion", "0", None), (1, "assertion", "1", None),
        (1, "it's\\.odd", "0", None), (1, "it's\\.odd", "1", None), (1, "it's\\.odd[]", "0/0", "0"), (1, "it's\\.odd[]", "0/1", "0"), (1, "it's\\.odd[]", "1/0", "1"),
    }
    # Without the schema's word that a role is a list, there is no such table.
    assert set(nested.list_tables(df.where("record_id = 0"))) == {"author"}


def test_any_depth_of_wrapping(spark):
    deep = [WORK]
    for i in range(9):
        deep = [{"message": json.dumps(deep)}] if i % 2 else [[deep]]
    assert rows(spark, [json.dumps(deep), json.dumps({"a": "message", "message": [[[[json.dumps({"message": [json.dumps(json.dumps(WORK))]})]]]]})]) == {0: EXPECTED, 1: EXPECTED}


def test_empty(spark):
    df = spark.createDataFrame([], "record_id long, payload string")
    assert nested.work_rows(df).count() == 0 and nested.merged_schema(nested.parse_records(df, "payload")).count() == 0
    assert set(nested.work_rows(df.withColumn("extra", F.lit(1))).columns) == {"record_id", "child", "path"}
