import json

import numpy as np
import pyarrow.parquet as pq
from brute_exports import rows

from geotrail.operators.shred import EXPORT, Node, Shredder, _deep_loads, find_segments, flatten_exports, positions, shred
from geotrail.plans.problems import p5_found

SEG = {"activity": {"topCandidate": {"type": "WALKING"}}}
PATH = {"timelinePath": [None, {"point": "35.1, 139.1"}, {"point": {"latLng": "bad"}}, {"point": {"latLng": "35.2, 139.2"}}]}
PAYLOADS = [
    None, "", "   ", "null", "[]", "{}", "17", "<html>", '{"semanticSegments": [', '{"semanticSegments": null}', "[NaN]",
    json.dumps({"semanticSegments": [None, SEG, PATH, {"visit": {}, **SEG}, {"visit": None, "activity": {}}, {"activity": None, **{"timelinePath": []}}]}),
    json.dumps({"semantic_segments": [{"activity": {"top_candidate": {"type": None}}}, {"timeline_path": [{"point": {"lat_lng": "1.5, 2.5"}}]}]}),
    json.dumps({"export": {"version": 3, "timeline": {"semanticSegments": [SEG, PATH]}}}),
    json.dumps([PATH, SEG]),
    "﻿" + json.dumps([PATH]),
    json.dumps(json.dumps({"semanticSegments": [PATH]})),
    json.dumps([{"timelinePath": json.dumps(PATH["timelinePath"])}, {"timelinePath": PATH["timelinePath"][1]}]),
    json.dumps([{"activity": {"topCandidate": {"type": "UNKNOWN_ACTIVITY_TYPE"}}}, {"activity": "odd"}]),
    json.dumps([PATH] * 3000),
]


def test_shapes_against_a_plain_walk(spark):
    df = spark.createDataFrame([(i, p, "x", 5) for i, p in enumerate(PAYLOADS)] + [(None, PAYLOADS[11], "x", 5)], "k bigint, p string, key string, segment_no int")
    got = sorted(tuple(r) for r in flatten_exports(df, "k", "p").collect())
    want = []
    for i, p in enumerate(PAYLOADS):
        if p and p != "[NaN]":
            want += [(i, *r) for r in rows(p)]
    assert got == sorted(want)
    assert flatten_exports(df.limit(0), "k", "p").count() == 0
    assert flatten_exports(df.where("k = 14").union(df.where("k = 14")), "k", "p").count() == 2 * len(list(rows(PAYLOADS[14])))


def test_levels_of_the_classic_example():
    # Names > languages > code, as in the published description of the encoding.
    schema = {"name": Node(("name",), repeated=True, children={"lang": Node(("lang",), repeated=True, children={"code": Node(("code",))})})}
    s = Shredder(schema)
    s.add({"name": [{"lang": [{"code": "en-us"}, {"code": "en"}]}, {}, {"lang": [{"code": "en-gb"}]}]})
    s.add({})
    c = s.columns["name.lang.code"]
    assert c.rep == [0, 2, 1, 1, 0] and c.values == ["en-us", "en", None, "en-gb", None]
    assert c.dfn == [5, 5, 2, 5, 0]
    parent, at = positions(np.array(c.rep), 1)
    assert parent.tolist() == [0, 0, 0, 0, 1] and at.tolist() == [0, 0, 1, 2, 0]


def test_segments_wrapped_at_any_depth(spark):
    wrap = lambda o, n, how: o if n == 0 else wrap(how(o), n - 1, how)
    doc = {"semanticSegments": [SEG, PATH]}
    deep = "[" * 60_000 + json.dumps(doc) + "]" * 60_000
    payloads = [json.dumps(wrap(doc, 50, lambda o: {"v": 1, "in": o})), json.dumps(wrap(doc, 30, lambda o: [o])), json.dumps([{"a": 1}, {"b": [doc]}]), deep, deep[:-1], '{"k":' * 50_000 + json.dumps(doc) + "}" * 50_000]
    df = spark.createDataFrame(list(enumerate(payloads)), "k bigint, p string")
    got = sorted(tuple(r) for r in flatten_exports(df, "k", "p").collect())
    one = [(0, "activity", 0, "WALKING"), (1, "path_point", 1, ""), (1, "path_point", 3, "")]
    assert got == [(k, *x) for k in (0, 1, 2, 3, 5) for x in one]
    assert find_segments([SEG]) == {"semanticSegments": [SEG]} and find_segments({"a": 1}) is None


def test_deep_reader_is_as_strict_as_the_library():
    texts = ['{"a": [1, -2.5e3, "x\\n\\"", true, null, {}], "b": []}', "[]", "{}", " 17 ", '"s"', "[1,]", "[,1]", "{,}", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "[1]]", "[", "{", "]", '["a', "01", "1.", "tru", '{1: 2}', "", '{"a":1 "b":2}', "[NaN]", '["\t"]', "[}", "{]"]
    for t in texts:
        try:
            want = json.loads(t, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            want = ValueError
        try:
            got = _deep_loads(t)
        except ValueError:
            got = ValueError
        assert got == want, t


def test_any_schema_as_one_table_for_each_repeated_field(spark):
    spec = {"owner": {"name": None}, "trips|trip_list[]": {"kind": None, "legs[]": {"mode|how": None, "stops[]": {"at": "place"}}, "tags[]": None}}
    docs = [
        {"owner": {"name": "A"}, "trips": [{"kind": "x", "legs": [{"mode": "bus", "stops": [{"at": {"place": "p"}}, None, {"at": "q"}]}, {"how": 3}], "tags": ["t", None]}, None, {"legs": []}]},
        {"trip_list": [{"legs": [{"stops": [{"at": None}]}]}]},
        {},
    ]
    df = spark.createDataFrame([(i, json.dumps(d), "c") for i, d in enumerate(docs)] + [(9, "[", "c"), (None, "{}", "c")], "k bigint, p string, record_key string")
    got = {name: sorted((tuple(r) for r in t.collect()), key=str) for name, t in shred(df, "k", "p", spec).items()}
    assert got[""] == [(0, "A"), (1, None), (2, None)]
    assert got["trips"] == [(0, 0, "x"), (0, 1, None), (0, 2, None), (1, 0, None)]
    assert got["trips.legs"] == [(0, 0, 0, "bus"), (0, 0, 1, "3"), (1, 0, 0, None)]
    assert got["trips.legs.stops"] == [(0, 0, 0, 0, "p"), (0, 0, 0, 1, None), (0, 0, 0, 2, "q"), (1, 0, 0, 0, None)]
    assert got["trips.tags"] == [(0, 0, 0, "t"), (0, 0, 1, None)]
    assert shred(df, "k", "p", spec)["trips.tags"].columns == ["record_key", "trips_no", "tags_no", "value"]
    assert all(t.count() == 0 for t in shred(df.limit(0), "k", "p", spec).values())


def test_visits_moves_and_points_of_exports_as_tables(spark, data):
    df = spark.read.parquet(f"{data}/raw_exports.parquet")
    tables = shred(df, "export_id", "payload", EXPORT, find_segments)
    flat = {tuple(r) for r in p5_found(spark, data).select("export_id", "segment_no").distinct().collect()}
    segments = {(r["record_key"], r["semanticSegments_no"]) for r in tables["semanticSegments"].collect()}
    points = {(r["record_key"], r["semanticSegments_no"]) for r in tables["semanticSegments.timelinePath"].collect()}
    assert flat <= segments and points <= segments and points


def test_whole_table_against_a_plain_walk(spark, data):
    want = {(r["export_id"], *x) for r in pq.read_table(f"{data}/raw_exports.parquet").to_pylist() if r["payload"] for x in rows(r["payload"])}
    assert {tuple(r) for r in p5_found(spark, data).collect()} == want
