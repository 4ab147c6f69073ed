"""Nested bodies against plain versions: balanced objects, canonical JSON, lookups, batches."""

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airgate.sources import bodies


def plain_balanced(text):
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "}" and depth == 0:
            return text[: i + 1]
    return None


def test_balanced_objects_equal_a_scan(spark):
    found = []
    given(st.text("{}a", max_size=25))(settings(max_examples=200, database=None)(lambda t: found.append("{" + t)))()
    texts = sorted({*found, "{", "{}", "{}}", "{{}", "{a{b}c{d{e}}}f}"})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", bodies.balanced(F.col("t")).alias("b")).collect()
    assert all(r["b"] == plain_balanced(r["t"]) for r in rows) and len(rows) > 50


def test_index_pages(spark):
    series = {"h100": [{"date": "$D2026-08-05T00:00:00Z", "avg": 2.5, "bottom": 0, "top": 3}, {"date": "$D2026-08-04", "avg": 0}, None, {"date": "2026-08-03", "avg": 2.0}], "b200": []}
    text = json.dumps({"x": "}{", "pricesByHardwareType": series, "y": {}})
    escaped = text.replace("\\", "\\\\").replace('"', '\\"')
    pages = [(1, f'<script>a("{escaped}")</script>'), (2, text), (3, escaped[:120]), (4, "pricesByHardwareType"), (5, None), (6, '"pricesByHardwareType":{not json}'), (7, "")]
    points = bodies.index_points(spark.createDataFrame(pages, "page long, body string"))
    rows = sorted(tuple(r) for r in points.collect())
    want = [("h100", 0, "2026-08-05", 2.5, 2.5, 3.0, True), ("h100", 1, "2026-08-04", 0.0, 0.0, 0.0, False), ("h100", 3, "2026-08-03", 2.0, 2.0, 2.0, True)]
    assert rows == [(p, *w) for p in (1, 2) for w in want]
    assert sorted(tuple(r) for r in bodies.index_quotes(points).collect()) == [(p, "h100", 2.5, 2.5, 3.0, "2026-08-05", 2, 2.0) for p in (1, 2)]


def plain_canonical(x, places=6):
    def rounded(v):
        if isinstance(v, float):
            v = round(v, places)
            return int(v) if v == int(v) else v
        if isinstance(v, dict):
            return {k: rounded(w) for k, w in v.items()}
        return [rounded(w) for w in v] if isinstance(v, list) else v

    return json.dumps(rounded(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_canonical_json_equals_a_plain_one(spark):
    names = st.text("abé\"\\{}[]:, 1.5e-", max_size=6)
    number = st.integers(-(10**12), 10**12) | st.integers(-(10**9), 10**9).map(lambda i: i / 1024)
    body = st.recursive(st.none() | st.booleans() | number | names, lambda x: st.lists(x, max_size=4) | st.dictionaries(names, x, max_size=4), max_leaves=12)
    found = []
    given(body)(settings(max_examples=150, database=None, deadline=None)(lambda x: found.append(x)))()
    rows = [(i, json.dumps(x, ensure_ascii=False, indent=1 + i % 2), plain_canonical(x)) for i, x in enumerate(found)]
    got = spark.createDataFrame(rows, "i int, body string, want string").select("want", bodies.canonical_json(F.col("body")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got] and len(got) > 100


def test_keys_are_shared_by_noise_and_order_only(spark):
    same = ['{"a": {"y": 1.0000001, "x": [3, 1]}, "b": -0.00000004}', '{"b":0.0,"a":{"x":[3,1],"y":1}}', '{"b":0, "a":{"x":[3,1.00000002],"y":0.99999996}}']
    other = ['{"a": {"y": 1.000001, "x": [3, 1]}, "b": 0}', '{"a": {"y": 1, "x": [1, 3]}, "b": 0}', '{"a": {"y": "1", "x": [3, 1]}, "b": 0}', "[]", "1e-9", None, "no json", ""]
    rows = spark.createDataFrame([(t,) for t in same + other], "body string")
    keys = [r[0] for r in rows.select(bodies.response_key(F.lit("v1"), F.col("body"))).collect()]
    assert len(set(keys[:3])) == 1 and keys[0] not in keys[3:] and keys[-3:] == [None] * 3 and len(set(keys[3:8])) == 5
    assert keys[0] == hashlib.sha256(b'v1\0{"a":{"x":[3,1],"y":1},"b":0}').hexdigest()
    assert rows.select(bodies.canonical_json(F.lit('{"big": 123456789012345678901234567890.5, "e": 1.5e300}'))).first()[0].startswith('{"big":123456789012345678901234567890.5,"e":1.5')


def test_lookup_facts(spark):
    full = {"county_fips": "01001", "state": None, "elevation_m": 12.5, "unknown": 1, "county_market": {"rent": None, "deep": {"a": [1]}}, "parcel": {"area_m2": 5, "geometry": {"x": 1}, "zoning": None, "source": "roll"}}
    gone = {"county_market": None, "parcel_unavailable": True, "parcel_unavailable_reason": "no_match"}
    rows = [(1, json.dumps(full)), (2, json.dumps(gone)), (3, "{}"), (4, "nope"), (5, None), (6, json.dumps({"parcel": {"apn": "x"}, "parcel_unavailable": False}))]
    got = sorted(tuple(r) for r in bodies.lookup_facts(spark.createDataFrame(rows, "site_id long, body string")).collect())
    assert got == sorted([
        (1, "county_fips", "01001", None, "lookup"), (1, "elevation_m", "12.5", "meters", "lookup"), (1, "county_market.rent", None, None, "county_market"), (1, "county_market.deep", '{"a":[1]}', None, "county_market"),
        (1, "parcel.area_m2", "5", "m2", "roll"), (1, "parcel.source", "roll", None, "roll"), (2, "parcel.unavailable_reason", "no_match", None, "lookup"), (6, "parcel.apn", "x", None, "parcel"),
    ])


def test_a_failed_entry_is_null_for_its_own_location_only(spark):
    entries = [{"index": 1, "ok": True, "fields": {"a": 1}}, {"index": 0, "ok": False, "fields": {"a": 2}}, {"index": 1, "ok": True, "fields": {"a": {"v": 3}}}, {"index": -1, "ok": True}, {"index": 9, "ok": True}, {"ok": True}, {"index": 2}]
    data = spark.createDataFrame([(1, json.dumps({"results": entries})), (2, "{}"), (3, "nope"), (5, None)], "batch long, body string")
    places = spark.createDataFrame([(b, p) for b in (1, 2, 3, 4) for p in range(4)], "batch long, place int")
    got = {(r["batch"], r["place"]): (r["status"], r["fields"]) for r in bodies.batch_results(places, data).collect()}
    assert len(got) == 16 and got[1, 1] == ("ok", {"a": '{"v":3}'}) and got[1, 0] == ("failed", None) and got[1, 2] == ("failed", None) and got[1, 3] == ("missing", None)
    assert {got[b, p] for b in (2, 3, 4) for p in range(4)} == {("missing", None)}
