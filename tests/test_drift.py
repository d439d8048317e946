import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import drift
from tastegrid.plans import core
from tastegrid.sources.tables import table

FILES = "file_id bigint, feed string, file_seq int"
RECORDS = "file_id bigint, line_no int, record string"


def blank(v):
    return v is None or (isinstance(v, str) and v.strip() in ("", "NR", "N/A", "NA", "na"))


def kind(values):
    names = {type(v).__name__ for v in values if not blank(v)}
    return next((k for k, n in ((3, "str"), (2, "float"), (1, "int"), (0, "bool")) if n in names), None)


def brute(files, records):
    """The definition, spelt out over Python dicts."""
    rows = defaultdict(list)
    for file_id, _, text in records:
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            continue
        if isinstance(value, dict):
            rows[file_id].append(value)
    by_place = {(feed, seq): i for i, feed, seq in files}
    out = set()
    for i, feed, seq in files:
        old = by_place.get((feed, seq - 1))
        if old is None:
            continue
        was, now = ({k for r in rows[f] for k in r} for f in (old, i))
        went, came = was - now, now - was
        renamed = set()
        for a in went:
            for b in came:
                pairs = [
                    (x[a], y[b]) for x in rows[old] for y in rows[i]
                    if x.get("url") is not None and x.get("url") == y.get("url") and not blank(x.get(a)) and not blank(y.get(b))
                ]
                if pairs and all(x == y for x, y in pairs):
                    renamed.add((a, b))
        out |= {(i, "renamed", a, b) for a, b in renamed}
        out |= {(i, "removed", a, "") for a in went - {a for a, _ in renamed}}
        out |= {(i, "added", "", b) for b in came - {b for _, b in renamed}}
        for k in was & now:
            x, y = (kind([r[k] for r in rows[f] if k in r]) for f in (old, i))
            if x is not None and y is not None and x != y:
                out.add((i, "retyped", k, k))
    return out


def changes(spark, files, records):
    got = drift.schema_changes(spark.createDataFrame(files, FILES), spark.createDataFrame(records, RECORDS)).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def lines(file_id, *rows):
    return [(file_id, n, json.dumps(r)) for n, r in enumerate(rows)]


def test_each_change(spark):
    files = [(1, "f", 1), (2, "f", 2), (3, "f", 3), (9, "g", 1)]
    records = [
        *lines(1, {"url": "a", "acid": 3, "milk": 1, "body": 2, "gone": 1}, {"url": "b", "acid": "NR", "milk": 2, "body": None}),
        *lines(2, {"url": "a", "acidity": 3, "milk": 1.5, "body": " "}, {"url": "c", "acidity": 9, "milk": True}),
        *lines(3, {"url": "a", "acidity": "3", "milk": 1.5, "body": 2, "new": None}),
        *lines(9, {"url": "a"}),
        (1, 9, '{"url": "cut'), (2, 9, "[1, 2]"), (2, 10, '"text"'), (2, 11, None), (2, 12, ""), (77, 1, '{"x": 1}'),
    ]
    expected = {
        (2, "renamed", "acid", "acidity"), (2, "removed", "gone", ""), (2, "retyped", "milk", "milk"),
        (3, "retyped", "acidity", "acidity"), (3, "added", "", "new"),
    }
    assert changes(spark, files, records + records[:3]) == expected
    assert brute(files, records) == expected


def test_missing_predecessor_empty_file_and_gaps(spark):
    files = [(1, "f", 1), (3, "f", 3), (4, "f", 4), (5, "f", 5), (6, None, 6), (7, "f", None)]
    records = [*lines(1, {"url": "a", "x": 1}), *lines(3, {"url": "a", "y": 1}), *lines(5, {"url": "a", "y": 1})]
    got = changes(spark, files, records)
    assert got == {(4, "removed", "url", ""), (4, "removed", "y", ""), (5, "added", "", "url"), (5, "added", "", "y")}
    assert got == brute([f for f in files if f[1] and f[2]], records)


def test_fields_that_equal_several(spark):
    files = [(1, "f", 1), (2, "f", 2)]
    records = [*lines(1, {"url": "a", "A": 1, "B": 1, "C": 2}, {"url": None, "A": 9}), *lines(2, {"url": "a", "X": 1.0, "Y": 1, "Z": "2"}, {"url": None, "X": 8})]
    got = changes(spark, files, records)
    assert got == brute(files, records) and {c for c in got if c[1] == "renamed"} == {(2, "renamed", a, b) for a in "AB" for b in "XY"}


def test_files_beyond_the_broadcast(spark, data, monkeypatch):
    whole = {tuple(r) for r in core.p1_found(spark, data).collect()}
    monkeypatch.setattr(drift, "BROADCAST_FILES", 0)
    assert {tuple(r) for r in core.p1_found(spark, data).collect()} == whole


def test_empty_tables_and_extra_columns(spark):
    assert changes(spark, [], []) == set()
    files = spark.createDataFrame([(1, "f", 1), (2, "f", 2)], FILES).withColumns({"field": F.lit("x"), "kind": F.lit(1), "url": F.lit("u")})
    records = spark.createDataFrame([*lines(1, {"a": 1}), *lines(2, {"a": "t", "long": "x" * 500_000})], RECORDS).withColumns({"feed": F.lit("z"), "value": F.lit(0), "salt": F.lit(1)})
    assert {tuple(r) for r in drift.schema_changes(files, records).collect()} == {(2, "retyped", "a", "a"), (2, "added", "", "long")}


def test_against_brute_force(spark, data):
    files = [(r.file_id, r.feed, r.file_seq) for r in table(spark, data, "export_files").collect()]
    records = [tuple(r) for r in table(spark, data, "export_records").select("file_id", "line_no", "record").collect()]
    got = {tuple(r) for r in core.p1_found(spark, data).collect()}
    assert got == brute(files, records) and got


def test_lifespans_and_consistent_table(spark, data):
    files = spark.createDataFrame([(1, "f", 1), (2, "f", 2), (3, "f", 3)], FILES)
    records = spark.createDataFrame([*lines(1, {"url": "a", "acid": 3}), *lines(2, {"url": "b", "Acidity": "4.5", "odd": 1}), *lines(3, {"url": "c", "acid": "Low"})], RECORDS)
    spans = drift.lifespans(drift.field_catalogue(files, records)).where("field = 'acid'").collect()
    assert sorted((r.first_seq, r.last_seq, r.kind) for r in spans) == [(1, 1, 1), (3, 3, 3)]
    rows = {r.url: r for r in drift.consistent_table(files, records).collect()}
    assert (rows["a"].acidity, rows["b"].acidity, rows["c"].acidity) == (3.0, 4.5, None)
    assert json.loads(rows["b"].extras) == {"odd": "1"} and json.loads(rows["c"].extras) == {"acid": "Low"}
    total = core.p1_consistent_table(spark, data)
    assert total.count() == table(spark, data, "export_records").distinct().where(F.try_parse_json("record").isNotNull()).count()


@pytest.mark.parametrize("text", ["1", "null", "[]", "{"])
def test_no_objects(spark, text):
    assert changes(spark, [(1, "f", 1), (2, "f", 2)], [(1, 1, text), (2, 1, text)]) == set()
