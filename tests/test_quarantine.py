import csv
import io
import json
import random

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewrack.functions.grammar import SyntaxFault, csv_record, csv_run, json_record, starts_record
from tidewrack.operators.quarantine import failed_lines, recovered_records, valid_records


def strict(text):
    def no(_):
        raise ValueError

    return json.loads(text, parse_constant=no)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=4), v, max_size=3), max_leaves=12)


@given(values, st.integers(0, 60), st.sampled_from(["", ",", "}", '"', "\\", "x", "\t", "1", " "]))
@settings(max_examples=400, deadline=None)
def test_json_grammar_accepts_what_is_strict_json(value, at, damage):
    text = json.dumps(value)
    for t in (text, text[:at] + damage + text[at:], text[:at]):
        try:
            want = strict(t)
        except (ValueError, RecursionError):
            want = SyntaxFault
        try:
            kind, found = json_record(t, ("artifact_id",))
        except SyntaxFault as e:
            assert want is SyntaxFault, (t, e)
            assert 0 <= e.at <= len(t)
            continue
        assert want is not SyntaxFault, t
        names = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}
        assert kind == names[type(want)]
        if isinstance(want, dict) and "artifact_id" in want:
            assert found["artifact_id"][0] == names[type(want["artifact_id"])]


def test_json_text_depth_and_repeated_names():
    assert json_record("[" * 50_000 + "]" * 50_000, ())[0] == "array"
    assert json_record(r'{"a": "😀\n", "a": "éA"}', ("a",))[1]["a"] == ("string", "éA")
    assert json_record('{"b": {"a": 1}, "a": 1.50}', ("a",))[1]["a"] == ("number", "1.50")


@given(st.lists(st.text(alphabet='a,b" ;', max_size=6), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_csv_grammar_reads_what_a_writer_wrote(fields):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(fields)
    if out.getvalue():
        assert csv_record(out.getvalue()) == fields


def test_csv_recovers_at_the_next_record():
    text = 'a1,x,"two\nlines"\na2,x,"never closed\na3,x,y\nbad"quote,x,y\na4,x,y'
    got = [(i + 1, v, f) for i, _, v, f in csv_run(text.split("\n"), 3)]
    assert [(n, v) for n, v, f in got if v] == [(1, ["a1", "x", "two\nlines"]), (4, ["a3", "x", "y"]), (6, ["a4", "x", "y"])]
    assert [n for n, v, f in got if f] == [3, 5]


LINES = [
    ("a.jsonl", 1, '﻿{"artifact_id": " x1 ", "text": "hi"}', None), ("a.jsonl", 2, '{"artifact_id": "x1"}', "duplicate_id"), ("a.jsonl", 3, "   ", None), ("a.jsonl", 4, None, None),
    ("a.jsonl", 5, '{"artifact_id": NaN}', "bad_json"), ("a.jsonl", 6, "[1]", "not_object"), ("a.jsonl", 7, '{"artifact_id": null, "text": 3}', "no_id"), ("a.jsonl", 8, '{"artifact_id": "  "}', "no_id"),
    ("a.jsonl", 9, '{"artifact_id": true}', "bad_value"), ("a.jsonl", 10, '{"artifact_id": 7, "text": ["t"]}', "bad_value"), ("a.jsonl", 11, '{"artifact_id": 7, "text": null}', None), ("a.jsonl", 12, "", None),
    ("a.jsonl", 13, '{"artifact_id": "X1", "text": "' + "y" * 200_000 + '"}', None), ("a.jsonl", 14, '﻿{"artifact_id": "x9"}', "bad_json"),
    ("b.csv", 1, "﻿artifact_id,source,text", None), ("b.csv", 2, '7,s,"a ""b"", c"', "duplicate_id"), ("b.csv", 3, 'c1,s,"open', "bad_quoting"), ("b.csv", 4, 'c1,s,a"b', "bad_quoting"), ("b.csv", 5, 'c1,"s"x,t', "bad_quoting"),
    ("b.csv", 6, "c1,s", "column_count"), ("b.csv", 7, " ,s,t", "no_id"), ("b.csv", 8, "c1,s,t\r", None), ("b.csv", 9, "", None), ("b.csv", 10, '"c2";"s";t', "bad_quoting"),
]


def test_lines(spark):
    df = spark.createDataFrame([(f, n, x, "r") for f, n, x, _ in LINES], "file_name string, line_no int, line string, reason string")
    got = {(f, n): r for f, n, r in rows(failed_lines(df), "file_name", "line_no", "reason")}
    assert got == {(f, n): r for f, n, _, r in LINES if r}
    good = rows(valid_records(df), "file_name", "line_no", "artifact_id")
    assert good == [("a.jsonl", 1, "x1"), ("a.jsonl", 11, "7"), ("a.jsonl", 13, "X1"), ("b.csv", 8, "c1")]
    assert failed_lines(df.limit(0)).count() == 0
    place = {(r.file_name, r.line_no): (r.fault_at, r.fault) for r in failed_lines(df).collect()}
    assert place["b.csv", 3][0] == 5 and place["a.jsonl", 2][1] == "first in a.jsonl:1"


def test_records_keep_every_field(spark):
    lines = [
        ("a.jsonl", 1, '{"artifact_id": "x1", "ts": "2026-01-01", "text": "a\\tb", "meta": {"k": [1, {"z": "}"}]} , "n": 1.50, "ok": true, "parent_id": null, "to": [], "more": [ {"ts": 2} ]}'),
        ("b.csv", 1, "artifact_id,source,ts,text"), ("b.csv", 2, 'c1,s,"1,2",t'),
    ]
    got = {r.artifact_id: [tuple(f) for f in r.fields] for r in valid_records(spark.createDataFrame(lines, "file_name string, line_no int, line string")).collect()}
    assert got == {
        "x1": [("artifact_id", "string", "x1"), ("ts", "string", "2026-01-01"), ("text", "string", "a\tb"), ("meta", "object", '{"k": [1, {"z": "}"}]}'), ("n", "number", "1.50"), ("ok", "boolean", "true"), ("parent_id", "null", None), ("to", "array", "[]"), ("more", "array", '[ {"ts": 2} ]')],
        "c1": [("artifact_id", "string", "c1"), ("source", "string", "s"), ("ts", "string", "1,2"), ("text", "string", "t")],
    }


def test_quotes_broken_over_lines(spark):
    """Reading by runs between anchors gives what reading each whole file gives."""
    r = random.Random(4)
    piece = ['a{i},x,"one', 'b{i},x,"he said ""no""', "two", 'three"', 'four" ', "", "c{i},x,y", 'd{i},"x","y, z"', 'e{i},x', 'f{i},"x"y,z', ' ,x,y', 'more, and more', '"', 'g{i},x,"open', ',,']
    files = {f"f{n}.csv": ["k,artifact_id,text" if n % 2 else "artifact_id,source,text", *[r.choice(piece).replace("{i}", str(i)) for i in range(120)]] for n in range(6)}
    files["hot.csv"] = ["artifact_id,source,text", *["x{},y,z".format(i) for i in range(900)], 'h1,s,"begins', *["prose"] * 40, 'ends"', 'h2,s,"never', "h3,s,t"]
    df = spark.createDataFrame([(f, i + 1, line, "x") for f, ls in files.items() for i, line in enumerate(ls)] + [("hot.csv", 3, "x1,y,z", "x"), ("a.jsonl", 1, "{", "x"), ("hot.csv", None, "x", "x")], "file_name string, line_no int, line string, run string")
    want = []
    for f, ls in files.items():
        for i, n, values, _ in csv_run(ls[1:], 3):
            named = dict(zip(ls[0].split(","), values, strict=True)) if values and len(values) == 3 else {}
            reason = "bad_quoting" if values is None else "column_count" if not named else None if named["artifact_id"].strip() else "no_id"
            want.append((f, i + 2, n, reason, named["artifact_id"].strip() if not reason else None, named["text"] if not reason else None))
    got = rows(recovered_records(df), "file_name", "line_no", "lines", "reason", "artifact_id", "text")
    assert set(got) == set(want) and len(got) == len(want)
    assert ("hot.csv", 902, 42, None, "h1", "\n".join(["begins", *["prose"] * 40, "ends"])) in got and ("hot.csv", 944, 1, "bad_quoting", None, None) in got
    assert starts_record('a1,"x', 3) and starts_record("x,y,z", 3) and not starts_record('more"', 3) and not starts_record("in words, that is", 3)
    assert recovered_records(df.limit(0)).count() == 0
